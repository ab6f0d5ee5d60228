"""Exact deduplication by Grace hashing.

Spark deals the records by content hash; inside a task a record goes to an
open-addressing table that compares whole contents.  When the table outgrows its
budget the records are partitioned by further hash bits to spill files, and each
file is treated the same way until it fits.

Every input partition first merges its own copies, so a group that holds a third
of all rows sends one record per partition, not one per row.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depgrove.llm.common import forget

#: Bytes of distinct content that one table may hold before it spills.
BUDGET = 128 << 20
FANOUT_BITS = 4
_ENTRY = 96


class OpenTable:
    """Linear probing over a power-of-two array of entry numbers; contents decide equality."""

    def __init__(self):
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.payloads: list = []
        self.held = 0

    def _place(self, h: int, content: bytes | None) -> int:
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (entry := slots[at]) >= 0:
            if content is not None and self.hashes[entry] == h and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, payload, merge: Callable) -> None:
        at = self._place(h, content)
        entry = self.slots[at]
        if entry >= 0:
            self.payloads[entry] = merge(self.payloads[entry], payload)
            return
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.payloads.append(payload)
        self.held += len(content) + _ENTRY
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, dtype=np.int64)
            for i, known in enumerate(self.hashes):
                self.slots[self._place(known, None)] = i

    def items(self) -> Iterator[tuple[int, bytes, object]]:
        return zip(self.hashes, self.contents, self.payloads, strict=True)


def merged(records: Iterator[tuple[int, bytes, object]], merge: Callable, budget: int = BUDGET, level: int = 0) -> Iterator[tuple[int, bytes, object]]:
    """One (hash, content, payload) for each content; payloads of copies are merged.

    Beyond ``64 / FANOUT_BITS`` levels all hash bits are used up; what is left there
    shares one 64-bit hash and stays in one table.
    """
    table, files, folder = OpenTable(), None, None
    shift = 64 - FANOUT_BITS * (level + 1)
    try:
        for h, content, payload in records:
            if files is None:
                table.add(h, content, payload, merge)
                if table.held <= budget or shift < 0:
                    continue
                folder = tempfile.mkdtemp(prefix="grace-")
                files = [open(f"{folder}/{i}", "wb") for i in range(1 << FANOUT_BITS)]  # noqa: SIM115
                for item in table.items():
                    pickle.dump(item, files[item[0] >> shift & len(files) - 1])
                table = OpenTable()
            else:
                pickle.dump((h, content, payload), files[h >> shift & len(files) - 1])
        if files is None:
            yield from table.items()
            return
        for f in files:
            f.close()
        for f in files:
            yield from merged(_spilled(f.name), merge, budget, level + 1)
            Path(f.name).unlink()
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _spilled(path: str) -> Iterator[tuple[int, bytes, object]]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _rank(doc_id) -> tuple:
    return (doc_id is not None, doc_id or 0)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``size`` bytes of content."""
    held, some = 0, []
    for row in rows:
        some.append(row)
        held += 64 + sum(len(x) * (8 if isinstance(x, list) else 1) for x in row if isinstance(x, (bytes, str, list)))
        if held > size or len(some) >= 20_000:
            yield _batch(some, schema)
            held, some = 0, []
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def classes(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Class of equal texts of every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty.  The row with the largest doc_id stays; null ids rank
    lowest, and of repeated rows with that id exactly one is kept.  An empty table
    gives an empty result; other columns, whatever their names, are not read.
    The input must return the same partitions when it is read again, as tables do.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def local(want_content: bool):
        schema = to_arrow_schema(T._parse_datatype_string("part int, h long, seq int, text binary, best long, n long" if want_content else "part int, h long, seq int, ids array<long>"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()

            def records():
                for b in batches:
                    for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                        content = text.as_py()
                        yield xxhash.xxh3_64_intdigest(content), content, [doc_id]

            def out():
                seen: dict[int, int] = {}  # contents that share a hash get different numbers, the same ones in every run
                for h, content, ids in merged(records(), _extend, budget):
                    signed = h - (1 << 64) if h >> 63 else h
                    seq = 0
                    if h in seen:
                        seq = seen[h] = seen[h] + 1
                    else:
                        seen[h] = 0
                    ids.sort(key=_rank, reverse=True)
                    yield (part, signed, seq, content, ids[0], len(ids)) if want_content else (part, signed, seq, ids)

            yield from _batches(out(), schema)

        return run

    first = rows.mapInArrow(local(True), "part int, h long, seq int, text binary, best long, n long")
    schema = to_arrow_schema(T._parse_datatype_string("part int, h long, seq int, keep_id long, group_size long, holder boolean, text_sha256 string"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for part, h, seq, text, best, n in zip(*(b.column(c).to_pylist() for c in ("part", "h", "seq", "text", "best", "n")), strict=True):
                    yield h & (1 << 64) - 1, text, [(part, h, seq, best, n)]

        def out():
            for _, content, locals_ in merged(records(), _extend, budget):
                digest = hashlib.sha256(content).hexdigest()
                keeper = max(locals_, key=lambda x: (_rank(x[3]), -x[0], -x[2]))
                size = sum(x[4] for x in locals_)
                for x in locals_:
                    yield (*x[:3], keeper[3], size, x is keeper, digest)

        yield from _batches(out(), schema)

    decisions = first.repartition("h").mapInArrow(decide, "part int, h long, seq int, keep_id long, group_size long, holder boolean, text_sha256 string")
    members = rows.mapInArrow(local(False), "part int, h long, seq int, ids array<long>")
    joined = members.join(decisions, ["part", "h", "seq"])
    return joined.select(F.posexplode("ids").alias("place", "doc_id"), "keep_id", "group_size", "holder", "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("holder") & (F.col("place") == 0)).alias("kept"), "text_sha256"
    )


def _extend(a: list, b: list) -> list:
    a.extend(b)
    return a


def _larger(a: tuple, b: tuple) -> tuple:
    return b if b[0] > a[0] else a


def distinct_texts(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the largest doc_id.

    Null text counts as empty, null ids rank lowest, and of rows that also share
    the id one stays, chosen by the text form of its other columns.
    """
    names = docs.columns
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), F.col("text").isNull().alias("void"))
    schema = to_arrow_schema(packed.withColumn("h", F.lit(0).cast("long")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def records():
            for b in batches:
                for doc_id, content, row, void in zip(*(b.column(c).to_pylist() for c in ("id", "content", "row", "void")), strict=True):
                    yield xxhash.xxh3_64_intdigest(content), content, ((_rank(doc_id), void, repr(row)), row)

        def out():
            for h, content, ((_, void, _), row) in merged(records(), _larger, budget):
                yield row["doc_id"], content, row, void, h - (1 << 64) if h >> 63 else h

        yield from _batches(out(), schema)

    kind = packed.withColumn("h", F.lit(0).cast("long")).schema
    once = packed.mapInArrow(run, kind).repartition("h").drop("h").mapInArrow(run, kind)
    return once.select(*[F.when(F.col("void"), F.lit(None)).otherwise(F.col("content").cast("string")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names])
