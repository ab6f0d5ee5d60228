"""Merging evidence: signals of a pair become one edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgrove.operators.codescan import is_noise

from depgrove.functions.evidence import noisy_or
from depgrove.schemas import ALGORITHM_WEIGHTS, OTHER_ALGORITHM_WEIGHT

PAIR = ["src", "dst"]


def algorithm_weight(name: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for item in ALGORITHM_WEIGHTS.items() for x in item])
    return F.coalesce(weights[name], F.lit(OTHER_ALGORITHM_WEIGHT))


def keep_best(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the row with the highest confidence; ``order`` breaks ties."""
    best = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), *order)
    return edges.withColumn("at__", F.row_number().over(best)).where("at__ = 1").drop("at__")


def keep_first(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the first row in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return edges.withColumn("at__", F.row_number().over(first)).where("at__ = 1").drop("at__")


def merge_max(signals: DataFrame) -> DataFrame:
    """Per pair the best confidence, the type and evidence that have it, and how many signals there are."""
    best = F.max_by(F.struct("type", "evidence"), F.struct("confidence", "type", "evidence"))
    return signals.groupBy(*PAIR).agg(F.max("confidence").alias("confidence"), best.alias("best"), F.count(F.lit(1)).alias("signals")).select(*PAIR, "confidence", "best.type", "best.evidence", "signals")


def merge_weighted(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key the mean confidence weighted by algorithm."""
    w = algorithm_weight(F.col("algorithm"))
    return signals.groupBy(*(keys or PAIR)).agg(F.round(F.sum(F.col("confidence") * w) / F.sum(w), 6).alias("confidence"), F.count(F.lit(1)).alias("signals"))


def merge_registry(signals: DataFrame) -> DataFrame:
    """Best of confidence times weight, 1 at most; a weight of 0 or less counts as 1."""
    w = F.when(F.col("weight") <= 0, 1.0).otherwise(F.col("weight"))
    return signals.groupBy(*PAIR).agg(F.round(F.least(F.lit(1.0), F.max(F.col("confidence") * w)), 6).alias("confidence"))


def merge_hybrid(signals: DataFrame, floor: float = 0.5, strategy: str = "max") -> DataFrame:
    """Signals under the floor go; the rest gives its maximum or its weighted mean, 1 at most."""
    kept = signals.where(F.col("confidence") >= floor)
    w = algorithm_weight(F.col("algorithm"))
    value = F.max("confidence") if strategy == "max" else F.sum(F.col("confidence") * w) / F.sum(w)
    return kept.groupBy(*PAIR).agg(F.round(F.least(F.lit(1.0), value), 6).alias("confidence"), F.count(F.lit(1)).alias("signals"))


def independent(signals: DataFrame) -> DataFrame:
    """Code and markdown evidence of a pair combined, with the source type that says which there was."""
    is_code = F.col("algorithm") == "code"
    best = signals.groupBy(*PAIR).agg(F.max(F.when(is_code, F.col("confidence"))).alias("c"), F.max(F.when(~is_code, F.col("confidence"))).alias("m"))
    kind = F.when(F.col("c").isNull(), "markdown").when(F.col("m").isNull(), "code").otherwise("both")
    return best.select(*PAIR, F.round(F.coalesce(noisy_or(F.col("c"), F.col("m")), "c", "m"), 6).alias("confidence"), kind.alias("source_type"))


def quality_gate(signals: DataFrame, solo: float = 0.6, dual: float = 0.65, triple: float = 0.6, llm: float = 0.5) -> DataFrame:
    """Pairs whose best signal passes the bar for the number of algorithms that saw them."""
    seen = signals.groupBy(*PAIR).agg(F.max("confidence").alias("confidence"), F.countDistinct("algorithm").alias("algorithms"), F.min("algorithm").alias("least"))
    only_llm = (F.col("algorithms") == 1) & (F.col("least") == "llm")
    bar = F.when(only_llm, llm).when(F.col("algorithms") == 1, solo).when(F.col("algorithms") == 2, dual).otherwise(triple)
    return seen.where(F.col("confidence") >= bar).drop("least")


def distinct_signals(signals: DataFrame) -> DataFrame:
    """One signal for each pair, algorithm and evidence: the strongest."""
    return signals.groupBy(*PAIR, "algorithm", "evidence").agg(F.max("confidence").alias("confidence"))


def summary(signals: DataFrame) -> DataFrame:
    """``kinds`` (distinct algorithms joined with +) and the number of signals of every pair."""
    return signals.groupBy(*PAIR).agg(F.array_join(F.sort_array(F.collect_set("algorithm")), "+").alias("kinds"), F.count(F.lit(1)).alias("signals"))


def union_discoveries(*found: DataFrame) -> DataFrame:
    """Outputs of several detectors merged by (src, dst, type): best confidence, all signal counts."""
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*PAIR, "type").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("signals"))


def manifest(edges: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Pairs for review: best confidence to four places, its type, and an earlier decision or ``pending``."""
    best = edges.groupBy(*PAIR).agg(F.round(F.max("confidence"), 4).alias("confidence"), F.max_by("type", F.struct("confidence", "type")).alias("type"))
    if decisions is None:
        return best.withColumn("status", F.lit("pending"))
    return best.join(decisions.select(*PAIR, "status"), PAIR, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def manifest_summary(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("status").agg(F.count(F.lit(1)).alias("pairs"))


def accepted_edges(reviewed: DataFrame, known: tuple[str, ...]) -> DataFrame:
    return reviewed.where(F.col("status") == "accepted").select(*PAIR, F.when(F.col("type").isin(*known), F.col("type")).otherwise("mentions").alias("type"), "confidence")


def without_explicit(found: DataFrame, explicit: DataFrame) -> DataFrame:
    """Discovered edges that the graph does not state already, by ends and type: these need a review."""
    return found.join(explicit.select(*PAIR, "type").distinct(), [*PAIR, "type"], "left_anti")


def first_known_type(signals: DataFrame, order: list[str], name: str = "dst", kind: str = "type") -> DataFrame:
    """``name`` and the type of its first signal in ``order`` that knows one, else ``unknown``; blank names are left out."""
    known = F.when((F.col(kind) != "") & (F.col(kind) != "unknown"), F.struct(*order, kind))
    typed = signals.where(F.col(name) != "").groupBy(name).agg(F.min(known).getField(kind).alias("known"))
    return typed.select(name, F.coalesce("known", F.lit("unknown")).alias("component_type"))


def boosted(signals: DataFrame, hint: str = "comment_hint", value: float = 0.5) -> DataFrame:
    """Signals of the kind ``hint`` whose target some other kind names as well get the confidence ``value``."""
    known = signals.where(F.col("signal_type") != hint).select("dst").distinct().withColumn("known", F.lit(True))
    raised = F.when((F.col("signal_type") == hint) & F.col("known"), F.lit(value)).otherwise(F.col("confidence"))
    return signals.join(known, "dst", "left").withColumn("confidence", raised).select(*signals.columns)


def with_registry(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """``src, dst, type, confidence``: a pair of the registry raises the first edge of that pair (by type), or is a ``mentions`` edge of its own.

    Of several registry rows of a pair the most certain counts.
    """
    given = registry.groupBy(*PAIR).agg(F.max("confidence").alias("given"))
    turn = F.row_number().over(Window.partitionBy(*PAIR).orderBy("type", F.col("confidence").desc()))
    both = edges.select(*PAIR, "type", "confidence").withColumn("turn", turn).join(given, PAIR, "full")
    value = F.when(F.coalesce("turn", F.lit(1)) == 1, F.greatest("confidence", "given")).otherwise(F.col("confidence"))
    return both.select(*PAIR, F.coalesce("type", F.lit("mentions")).alias("type"), value.alias("confidence"))


def with_missing_nodes(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """``id, title, component_type`` of all nodes and of the edges' ends that are none yet, typed by ``types`` (``id, component_type``) or ``unknown``; ends that are noise get none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where(~is_noise(F.col("id"))).join(nodes.select("id"), "id", "left_anti")
    stubs = ends.join(types.groupBy("id").agg(F.min("component_type").alias("component_type")), "id", "left").select("id", F.col("id").alias("title"), F.coalesce("component_type", F.lit("unknown")).alias("component_type"))
    return nodes.select("id", "title", "component_type").unionByName(stubs)


def merged_components(documents: DataFrame, infrastructure: DataFrame) -> DataFrame:
    """Components of documents by id (the most certain file stands for each); one of the infrastructure only where no document has its id."""
    best = keep_best(documents, ["id"], [F.col("file")])
    return best.unionByName(keep_best(infrastructure, ["id"], [F.col("file")]).join(best.select("id"), "id", "left_anti"))
