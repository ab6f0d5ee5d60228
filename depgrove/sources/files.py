"""Scanning document trees and saving, loading and checking graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depgrove.functions.text import strip_markdown, title
from depgrove.operators.graph import pruned
from depgrove.schemas import SCHEMA_VERSION

# Folders that a scan skips.
SKIPPED = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv", "coverage", "tmp", "out")


def matches(name: Column, pattern: str) -> Column:
    """``*``, ``*suffix``, ``prefix*`` or an exact name."""
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*"):
        return F.endswith(name, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(name, F.lit(pattern[:-1]))
    return name == pattern


def kept_path(path: Column, folders: tuple[str, ...] = SKIPPED, files: tuple[str, ...] = ()) -> Column:
    """No hidden or ignored folder on the way, no ignored file name."""
    parts = F.split(path, "/")
    above, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    bad = F.exists(above, lambda p: _any(p, folders))
    keep = ~bad
    for f in files:
        keep = keep & ~matches(name, f)
    return keep


def _any(part: Column, folders: tuple[str, ...]) -> Column:
    out = F.startswith(part, F.lit("."))
    for folder in folders:
        out = out | matches(part, folder)
    return out


def scan(spark: SparkSession, root: str, folders: tuple[str, ...] = SKIPPED, files: tuple[str, ...] = ()) -> DataFrame:
    """Markdown files under a folder as ``doc_id, path, title, content, plain_text, content_hash, last_modified``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    path = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    rows = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.md5("content").alias("content_hash"), F.col("modificationTime").alias("last_modified"))
    kept = rows.where(kept_path(F.col("path"), folders, files))
    return kept.select(F.col("path").alias("doc_id"), "path", title(F.col("content"), F.col("path")).alias("title"), "content", strip_markdown(F.col("content")).alias("plain_text"), "content_hash", "last_modified")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and the edges between them as Parquet, with the schema version; replaces what is there."""
    nodes.withColumn("component_type", F.coalesce(F.nullif("component_type", F.lit("")), F.lit("unknown"))).write.mode("overwrite").parquet(f"{path}/nodes")
    pruned(nodes, edges).write.mode("overwrite").parquet(f"{path}/edges")
    nodes.sparkSession.createDataFrame([("schema_version", str(SCHEMA_VERSION))], "key string, value string").write.mode("overwrite").parquet(f"{path}/metadata")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The saved pair; a newer schema version is refused."""
    version = spark.read.parquet(f"{path}/metadata").where("key = 'schema_version'").first()
    if version is None or int(version["value"]) > SCHEMA_VERSION:
        raise ValueError(f"{path} has schema version {version and version['value']}; this package reads up to {SCHEMA_VERSION}")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
