"""Incremental work: what changed, what to index again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, change`` with added, modified or deleted; content decides by its MD5."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    a, b = old.select(key, digest.alias("before")), new.select(key, digest.alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified")
    return a.join(b, key, "full").select(key, kind.alias("change")).where(F.col("change").isNotNull())


def upserted(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace current ones with the same key."""
    return current.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def is_stale(old: DataFrame, new: DataFrame) -> bool:
    return not changes(old, new).isEmpty()
