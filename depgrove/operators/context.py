"""What to read about a component: the documents around it, nearest first, under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgrove.operators.graph import reach
from depgrove.session import checkpointed


def documented(edges: DataFrame, component, docs: DataFrame, depth: int = 2, budget: int = 50_000) -> DataFrame:
    """``id, distance, text, cut`` of the components within ``depth`` hops of one, in either direction, that have documents.

    ``docs`` has ``id, text``, one row for each id.  Texts are taken by distance, then id, until
    ``budget`` characters are full; the last one is cut there.  Null and empty texts take
    no part.  Every text that is taken has a character at least, so no more than
    ``budget`` lengths are summed up in order; the texts themselves stay where they are.
    """
    if budget < 1:
        raise ValueError(f"the budget must be 1 or more, not {budget}")
    start = edges.sparkSession.createDataFrame([(component,)], "id string").select(F.col("id").cast(edges.schema["src"].dataType))
    rows = reach(edges, start, "both", depth).join(docs.select("id", "text").where(F.length("text") > 0), "id")
    first = checkpointed(rows.select("id", "distance", F.length("text").cast("long").alias("size")).orderBy("distance", "id").limit(budget))
    before = F.coalesce(F.sum("size").over(Window.orderBy("distance", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("left", F.lit(budget) - before).where("left > 0").select("id", "distance", "size", F.least("size", "left").alias("taken"))
    return taken.join(docs.select("id", "text"), "id").select("id", "distance", F.substr("text", F.lit(1), F.col("taken").cast("int")).alias("text"), (F.col("taken") < F.col("size")).alias("cut"))


def related(edges: DataFrame, component, depth: int = 2) -> DataFrame:
    """``id, other, relation, confidence``: what each component that a walk expands depends on and is used by."""
    start = edges.sparkSession.createDataFrame([(component,)], "id string").select(F.col("id").cast(edges.schema["src"].dataType))
    edges = checkpointed(edges.select("src", "dst", "confidence"))  # read three times
    expanded = checkpointed(reach(edges, start, "both", depth).where(F.col("distance") < depth).select("id"))
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("depends_on").alias("relation"), "confidence")
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("used_by").alias("relation"), "confidence")
    return out.unionByName(back).join(expanded, "id", "left_semi")
