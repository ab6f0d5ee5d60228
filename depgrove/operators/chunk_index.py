"""A chunk index that is updated instead of rebuilt.

An index is a folder of versions.  A version holds the chunks and postings of the
documents it added, one row for every document it added or removed, and signed changes
of the document frequencies and of the corpus size.  Of a document the latest version
counts, so removing one writes a row and deletes nothing.  A row of the manifest, added
when everything else is written, makes a version visible: readers see the former state
or the new one.  Compaction writes what is live as one version on which later ones rest.

One writer at a time; readers need no lock, as files are only ever added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgrove.functions.text import tokens
from depgrove.operators import sections
from depgrove.operators.search import K1, B
from depgrove.session import checkpointed

SCHEMAS = {
    "docs": "doc_id string, digest string, removed boolean, version int",
    "chunks": "chunk_id string, doc_id string, heading_path string, start_line long, end_line long, content string, chunk_len int, version int",
    "postings": "term string, chunk_id string, doc_id string, tf long, chunk_len int, version int",
    "df": "term string, delta long",
    "size": "chunks long, tokens long",
}
MANIFEST = "version int, base int, folder string"


def _distinct(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of repeated ids the least text; only the texts of repeated ids are compared."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = checkpointed(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return rows
    least = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(repeated, "doc_id", "left_anti").unionByName(least)


def _postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, doc_id, chunk_len, tf`` of chunks with their ``tokens``."""
    words = chunks.select("chunk_id", "doc_id", "chunk_len", F.explode("tokens").alias("term"))
    return words.groupBy("term", "chunk_id", "doc_id", "chunk_len").agg(F.count(F.lit(1)).alias("tf"))


class ChunkIndex:
    """The index in ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> list:
        """The versions that are visible, oldest first."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()  # a row a version
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        if not rows:
            return []
        base = max(rows, key=lambda r: r["version"])["base"]
        return sorted((r for r in rows if r["version"] >= base), key=lambda r: r["version"])

    @property
    def version(self) -> int:
        return max((r["version"] for r in self._manifest()), default=0)

    def _read(self, name: str) -> DataFrame:
        folders = [f"{self.path}/{r['folder']}/{name}" for r in self._manifest()]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def documents(self) -> DataFrame:
        """``doc_id, digest, version`` of the documents that are in the index."""
        last = self._read("docs").groupBy("doc_id").agg(F.max(F.struct("version", "removed", "digest")).alias("x"))
        return last.where("NOT x.removed").select("doc_id", "x.digest", "x.version")

    def _live(self, name: str) -> DataFrame:
        return self._read(name).join(self.documents().select("doc_id", "version"), ["doc_id", "version"], "left_semi")

    def chunks(self) -> DataFrame:
        return self._live("chunks").drop("version")

    def postings(self) -> DataFrame:
        return self._live("postings").drop("version")

    def frequencies(self) -> DataFrame:
        """``term, df``: chunks with the term, from the signed changes of all versions."""
        return self._read("df").groupBy("term").agg(F.sum("delta").alias("df")).where("df > 0")

    def size(self) -> DataFrame:
        """One row: the number of chunks and of their tokens."""
        return self._read("size").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """Add or replace ``docs`` (``doc_id, text``), drop the ids of ``removed(doc_id)``; the new version.

        A document whose text has the digest that the index knows is skipped.  A null
        text is empty, null ids are left out; of repeated ids the least text counts, and
        an id that is both given and removed is replaced.
        """
        manifest = self._manifest()
        version = max((r["version"] for r in manifest), default=0) + 1
        base = manifest[0]["base"] if manifest else version
        current = checkpointed(self.documents())
        given = checkpointed(_distinct(docs).withColumn("digest", F.md5(F.col("text").cast("binary"))))
        fresh = given.join(current.select("doc_id", F.col("digest").alias("known")), "doc_id", "left").where("known IS NULL OR known != digest").drop("known")
        gone = removed.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(current, "doc_id", "left_semi").join(given, "doc_id", "left_anti") if removed is not None else self.spark.createDataFrame([], "doc_id string")
        rows = fresh.select("doc_id", "digest", F.lit(False).alias("removed")).unionByName(gone.select("doc_id", F.lit(None).cast("string").alias("digest"), F.lit(True).alias("removed")))
        touched = checkpointed(rows.join(current.select("doc_id", F.lit(True).alias("was")), "doc_id", "left"))
        cut = sections.chunks(fresh).withColumn("tokens", tokens(F.col("content")))
        chunks = checkpointed(cut.select("chunk_id", "doc_id", "heading_path", "start_line", "end_line", "content", F.size("tokens").alias("chunk_len"), "tokens"))
        folder = self._folder(version)
        # a chunk's terms are counted beside it; the changes of the frequencies come from what was written
        postings = self._write(folder, version, postings=_postings(chunks))["postings"]
        lost = touched.where("was").select("doc_id")
        old_postings, old_chunks = (self._live(n).join(lost, "doc_id", "left_semi") for n in ("postings", "chunks"))
        df = postings.select("term", F.lit(1).alias("d")).unionByName(old_postings.select("term", F.lit(-1).alias("d"))).groupBy("term").agg(F.sum("d").alias("delta")).where("delta != 0")
        size = chunks.select(F.lit(1).alias("c"), "chunk_len").unionByName(old_chunks.select(F.lit(-1).alias("c"), (-F.col("chunk_len")).alias("chunk_len"))).agg(F.sum("c").alias("chunks"), F.sum("chunk_len").alias("tokens"))
        self._write(folder, version, docs=touched.drop("was"), chunks=chunks.drop("tokens"), df=df, size=size)
        self._commit(version, base, folder)
        return version

    def compact(self) -> int:
        """Write what is live as one version on which later ones rest; the new version."""
        version = self.version + 1
        docs = self.documents().select("doc_id", "digest", F.lit(False).alias("removed"))
        size = self.size()
        folder = self._folder(version)
        self._write(folder, version, docs=docs, chunks=self.chunks(), postings=self.postings(), df=self.frequencies().select("term", F.col("df").alias("delta")), size=size)
        self._commit(version, version, folder)
        return version

    def _folder(self, version: int) -> str:
        return f"v{version}-{uuid.uuid4().hex}"  # a writer that was lost leaves a folder that no manifest names

    def _write(self, folder: str, version: int, **tables: DataFrame) -> dict[str, DataFrame]:
        """The tables as they are read from the folder of a version."""
        out = {}
        for name, table in tables.items():
            if "version" in SCHEMAS[name]:
                table = table.withColumn("version", F.lit(version))
            wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
            table.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(f"{self.path}/{folder}/{name}")
            out[name] = self.spark.read.schema(wanted).parquet(f"{self.path}/{folder}/{name}")
        return out

    def _commit(self, version: int, base: int, folder: str) -> None:
        self.spark.createDataFrame([(version, base, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def search(self, terms: list[str], k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """``chunk_id, doc_id, score, matched``: best chunks by BM25, ties by id; repeated terms count again."""
        query = self.spark.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, times int")
        post = self.postings().where(F.col("term").isin(*set(terms)))
        idf = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("chunk_len") / (F.col("tokens") / F.col("chunks"))))
        scored = post.join(self.frequencies(), "term").join(F.broadcast(query), "term").crossJoin(self.size())  # one row
        return scored.groupBy("chunk_id", "doc_id").agg(F.round(F.sum(part * F.col("times")), 6).alias("score"), F.sum("times").alias("matched")).orderBy(F.desc("score"), "chunk_id").limit(k)
