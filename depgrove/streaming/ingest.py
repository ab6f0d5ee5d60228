"""Structured Streaming: windowed counts, incremental edges, changed documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgrove.operators.changes import upserted
from depgrove.session import checkpointed, shared_folder


def _drained(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result table."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")

    done = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    done.awaitTermination()
    last = max((p["batchId"] for p in done.recentProgress if p["numInputRows"]), default=0)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/{last}")


def windowed_counts(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` by hour of an event stream in Parquet files; rows ``late`` and more may be dropped in append mode."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{path}*")  # a file or a folder of that name
    hourly = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _drained(hourly.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), spark, "complete")


def streamed_best_edges(spark: SparkSession, signals: DataFrame) -> DataFrame:
    """``src, dst, confidence, signals``: the running best of every pair over a stream of signals."""
    landed = f"{shared_folder(spark)}/signals-{uuid.uuid4().hex}"
    signals.write.parquet(landed)
    arriving = spark.readStream.schema(signals.schema).parquet(landed)
    best = arriving.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("signals"))
    return _drained(best, spark, "complete")


def upsert_documents(arriving: DataFrame, path: str, key: str = "doc_id"):
    """Start a stream that keeps a document table current: each batch replaces the rows it brings."""
    spark = arriving.sparkSession

    def merge(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            current = spark.read.parquet(path)
        except Exception as missing:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            fresh.write.parquet(path)
            return
        checkpointed(upserted(current, fresh, [key])).write.mode("overwrite").parquet(path)

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}.state")
