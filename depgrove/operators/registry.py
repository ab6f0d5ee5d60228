"""A registry of components and of the signals on their relations, gathered from several sources.

Signals stay rows, one for each pair, kind and evidence, so a pair with very many of them
is never one list; a relation holds a map from kind to what that kind says in short.
Registries are merged by uniting their signals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depgrove.functions.text import stem
from depgrove.operators.classify import inferred_type

SIGNALS = "src string, dst string, kind string, evidence string, confidence double, weight double"


def registry_id(node: Column) -> Column:
    """The id of a node's component: its file's name in lower case, without folder and extension."""
    return F.lower(stem(node))


def components(nodes: DataFrame) -> DataFrame:
    """``id, name, type, file`` of ``id, title`` nodes: the least node stands for a component; its path tells the type."""
    first = nodes.where("id IS NOT NULL").groupBy(registry_id(F.col("id")).alias("key")).agg(F.min(F.struct("id", "title")).alias("x")).where("key != ''")
    return first.select(F.col("key").alias("id"), F.col("x.title").alias("name"), inferred_type(F.col("x.id"))["type"].alias("type"), F.col("x.id").alias("file"))


def signals(edges: DataFrame, kind: str, evidence: Column, weight: float = 1.0) -> DataFrame:
    """Signals of ``src, dst, confidence`` edges between nodes or ids, with the component ids of their ends."""
    return edges.select(registry_id(F.col("src")).alias("src"), registry_id(F.col("dst")).alias("dst"), F.lit(kind).alias("kind"), evidence.alias("evidence"), F.col("confidence").cast("double").alias("confidence"), F.lit(weight).alias("weight"))


def united(*given: DataFrame, parts: int | None = None) -> DataFrame:
    """Signals of all sources: of equal pair, kind and evidence the most certain stays; pairs of one component or without an id go.

    The signals of a pair are moved once, to the task that makes its relation too;
    ``parts`` is the number of these tasks, the session's number if none.
    """
    rows = reduce(DataFrame.unionByName, given).where("src != '' AND dst != '' AND src != dst")
    rows = rows.repartition(parts, "src", "dst") if parts else rows.repartition("src", "dst")
    score = F.struct("confidence", "weight")
    return rows.groupBy("src", "dst", "kind", "evidence").agg(F.max(score).alias("x")).select("src", "dst", "kind", "evidence", "x.confidence", "x.weight")


def relations(rows: DataFrame) -> DataFrame:
    """``src, dst, confidence, by_kind, signals``: the strongest signal, confidence times weight and 1 at most, and a map of the kinds.

    A kind's entry has its number of signals, its best confidence and the evidence of
    that.  A weight of 0 or less counts as 1.
    """
    w = F.when(F.col("weight") <= 0, 1.0).otherwise(F.col("weight"))
    kinds = rows.groupBy("src", "dst", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max_by("evidence", F.struct("confidence", "evidence")).alias("evidence"), F.max(F.col("confidence") * w).alias("score"),
    )
    entry = F.struct("kind", F.struct("n", "confidence", "evidence"))
    out = kinds.groupBy("src", "dst").agg(F.round(F.least(F.lit(1.0), F.max("score")), 6).alias("confidence"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_kind"), F.sum("n").alias("signals"))
    return out


def at_least(related: DataFrame, confidence: float) -> DataFrame:
    """Relations of that confidence or more, the most certain first."""
    return related.where(F.col("confidence") >= confidence).orderBy(F.desc("confidence"), "src", "dst")


def named(known: DataFrame, name: str) -> DataFrame:
    """The components of a name, whatever its case."""
    return known.where(F.lower("name") == name.lower())


def node_edges(related: DataFrame, known: DataFrame) -> DataFrame:
    """``src, dst, confidence`` between the files that stand for the components; relations of others go."""
    a = related.join(known.select(F.col("id").alias("src"), F.col("file").alias("from")), "src")
    return a.join(known.select(F.col("id").alias("dst"), F.col("file").alias("to")), "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"), "confidence")


def save(known: DataFrame, rows: DataFrame, path: str) -> None:
    """Components and signals as JSON lines in two folders of ``path``, which must be new."""
    known.write.json(f"{path}/components")
    rows.write.json(f"{path}/signals")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("id string, name string, type string, file string").json(f"{path}/components"), spark.read.schema(SIGNALS).json(f"{path}/signals")
