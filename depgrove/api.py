"""The engine: one graph and its documents, queries as DataFrames or as JSON."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgrove.functions.text import lines
from depgrove.operators import discover, evidence, graph, search, vectors
from depgrove.schemas import EDGE_TYPES, SCHEMA_VERSION
from depgrove.sources import files


class QueryError(Exception):
    """A failed query: code MISSING_ARG, INVALID_ARG, NOT_FOUND or NO_GRAPH, and names that come near."""

    def __init__(self, code: str, message: str, suggestions: list[str] | None = None):
        super().__init__(message)
        self.code, self.suggestions = code, suggestions or []


def depth_of(text: str | int | None) -> int | None:
    """``all`` or None means no limit; whole numbers below 1 count as 1."""
    if text is None or text == "all":
        return None
    try:
        return max(1, int(text))
    except ValueError:
        raise QueryError("INVALID_ARG", f"depth must be a number or all, not {text!r}") from None


class Engine:
    """Queries over ``nodes(id, type, title, component_type)`` and ``edges``; ``docs`` for search."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None, mentions: DataFrame | None = None):
        self.spark, self.nodes, self.edges, self.docs, self.mentions = spark, nodes, edges, docs, mentions

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(spark, *files.load_graph(spark, path))

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, min_confidence: float = 0.5) -> Engine:
        """A graph from ``doc_id, path, title, content`` documents: links, verbs and co-occurring names."""
        text = docs.select("doc_id", "path", F.col("content").alias("text"))
        names = docs.select(F.lower(F.regexp_replace("path", r"^.*/|\.[^.]*$", "")).alias("name")).distinct()
        rows = lines(text)
        found = evidence.union_discoveries(
            discover.link_edges(text, text.select("path")).select("src", "dst", "type", "confidence"),
            discover.relations(rows).join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst", "type", "confidence"),
            discover.cooccurrence(rows, names).select("src", "dst", F.lit("mentions").alias("type"), "confidence"),
        )
        edges = found.where(F.col("confidence") >= min_confidence).withColumn("source_type", F.lit("markdown"))
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        nodes = ends.join(docs.select(F.col("path").alias("id"), "title"), "id", "left").select("id", F.lit("document").alias("type"), "title", F.lit("unknown").alias("component_type"))
        return cls(spark, nodes, edges, text)

    def _known(self, component: str | None) -> str:
        if not component:
            raise QueryError("MISSING_ARG", "a component is needed")
        if self.nodes.where(F.col("id") == component).isEmpty():
            near = search.suggestions(self.nodes.select(F.col("id").alias("name")), component).collect()
            raise QueryError("NOT_FOUND", f"no component {component!r}", [r["name"] for r in near])
        return component

    def _named(self, found: DataFrame, most_mentions: int | None) -> DataFrame:
        out = found.join(self.nodes.select("id", F.coalesce(F.nullif("component_type", F.lit("")), F.lit("unknown")).alias("component_type")), "id", "left")
        out = out.select(F.col("id").alias("name"), F.col("component_type").alias("type"), "distance", "confidence_tier")
        if most_mentions is None or self.mentions is None:
            return out
        row = F.struct((-F.col("confidence")).alias("order"), "file_path", "heading_hierarchy", "detected_by", "confidence")
        seen = self.mentions.groupBy(F.col("component_id").alias("name")).agg(F.sort_array(F.collect_list(row)).alias("every"))
        first = F.slice("every", 1, most_mentions) if most_mentions else F.col("every")
        return out.join(seen, "name", "left").withColumns({"mentions": first, "mention_count": F.coalesce(F.size("every"), F.lit(0))}).drop("every")

    def impact(self, component: str, depth="1", min_confidence: float = 0.0, source_type: str | None = None, most_mentions: int | None = None) -> DataFrame:
        """What is affected when a component changes: ``name, type, distance, confidence_tier``."""
        return self._named(graph.impact(self.edges, self._known(component), depth_of(depth), min_confidence, source_type), most_mentions)

    def dependencies(self, component: str, depth="1", min_confidence: float = 0.0, source_type: str | None = None, most_mentions: int | None = None) -> DataFrame:
        """What a component needs: the same columns."""
        return self._named(graph.dependencies(self.edges, self._known(component), depth_of(depth), min_confidence, source_type), most_mentions)

    def path(self, source: str, target: str, limit: int = 10, min_confidence: float = 0.0, source_type: str | None = None) -> DataFrame:
        """The ``limit`` shortest simple paths by total confidence: ``nodes, hops, total_confidence``; none from a node to itself."""
        kept = graph.filtered(self.edges, min_confidence, source_type)
        found = graph.k_shortest(kept, self._known(source), self._known(target), limit)
        out = found.select(F.col("path").alias("nodes"), "hops", F.round("confidence", 6).alias("total_confidence"))
        return out.orderBy(F.col("total_confidence").desc(), "hops", F.array_join("nodes", ">"))

    def list(self, component_type: str | None = None, min_confidence: float = 0.0, source_type: str | None = None) -> DataFrame:
        return graph.listing(self.nodes, self.edges, component_type, min_confidence, source_type).orderBy("name")

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges)

    def info(self) -> dict:
        row = self.stats().first()
        return {"component_count": row["nodes"], "relationship_count": row["edges"], "schema_version": SCHEMA_VERSION, "edge_types": list(EDGE_TYPES)}

    def similar(self, component: str, k: int = 10) -> DataFrame:
        """Nearest components by placeholder vector."""
        vec = vectors.placeholder(self.nodes).select(F.col("id").alias("vec_id"), "embedding")
        return vectors.nearest(vec, self._known(component), k).select(F.col("vec_id").alias("name"), "similarity")

    def search(self, text: str, k: int = 10) -> DataFrame:
        if self.docs is None:
            raise QueryError("NO_GRAPH", "this engine has no documents")
        terms = [t for t in text.lower().split() if len(t) >= 2]
        return search.bm25(self.docs, terms, k) if terms else self.docs.sparkSession.createDataFrame([], "doc_id string, score double, matched long")


def to_json(kind: str, parameters: dict, run) -> str:
    """The answer of ``run()`` as an envelope ``query, results, metadata``, or its error."""
    begin = time.time()
    try:
        results = [json.loads(r) for r in run().toJSON().collect()]
    except QueryError as e:
        return json.dumps({"error": {"code": e.code, "message": str(e), "suggestions": e.suggestions}})
    return json.dumps({"query": {"type": kind} | parameters, "results": results, "metadata": {"count": len(results), "elapsed_ms": round(1000 * (time.time() - begin))}})


def to_dot(edges: DataFrame) -> str:
    """A small graph for Graphviz; thicker lines are more certain."""
    line = F.format_string('  "%s" -> "%s" [label="%s", penwidth=%.2f];', "src", "dst", "type", 0.5 + 2.5 * F.col("confidence"))
    return "\n".join(["digraph dependencies {", *[r[0] for r in edges.select(line).orderBy(line).collect()], "}"])
