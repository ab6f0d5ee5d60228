"""Removal of repeated passages with fixed-block anchors.

Every document of at least one window is cut into non-overlapping reference blocks.
A window holds several whole blocks wherever it starts, so it is enough to index a
block that is the least, by hash, among that many neighbours; the rolling windows of
block size that are least among their strided neighbours probe that index.  Blocks
that two documents share are anchors.  Around every anchor the hit is extended over
all full windows that contain it, the occurrences of each window meet, and those
outside the smallest doc_id are covered; runs of covered windows are the maximal
exact repeats.

The index and the anchors travel as bitmaps of fixed size, where a false hit costs
work only; what is removed is decided by the windows themselves.  Each partition
settles its own repeats first, so a passage that every document holds sends one
document per partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgrove.llm.common import Words, checkpointed, hashed_bitmap, in_bitmap, signed, text_blocks

WINDOW = 50
BLOCK = 10
INDEX_BITS, ANCHOR_BITS, DOCUMENT_BITS = 27, 26, 22
#: A null doc_id counts as larger than every other.
LAST = (1 << 63) - 1
#: Candidate windows that a partition gathers before it settles them.
GATHER = 600_000


def run_of_blocks(window: int, block: int) -> int:
    """Whole aligned blocks in a window, wherever it starts."""
    return (window - block + 1) // block


def least_in_run(hashes: np.ndarray, stride: int, run: int) -> np.ndarray:
    """Whether an element is the least of some ``run`` elements ``stride`` apart that include it."""
    reach = stride * (run - 1)
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) <= reach:
        return out
    least = hashes[: len(hashes) - reach].copy()
    for k in range(1, run):
        np.minimum(least, hashes[stride * k : len(hashes) - reach + stride * k], out=least)
    for k in range(run):
        out[stride * k : len(least) + stride * k] |= hashes[stride * k : len(least) + stride * k] == least
    return out


class _Finder:
    def __init__(self, window: int, block: int):
        self.window, self.block, self.run = window, block, run_of_blocks(window, block)
        if self.run < 1:
            raise ValueError("a window must hold a whole block wherever it starts")

    def documents(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, Words]]:
        """Number, first word and rolling block hashes of every text with a full window."""
        words = Words(texts)
        rolled, _ = words.windows(self.block)
        for i in range(len(texts)):
            begin, end = int(words.first[i]), int(words.first[i + 1])
            if end - begin >= self.window:
                yield i, begin, rolled[begin : end - self.block + 1], words

    def reference(self, rolled: np.ndarray) -> np.ndarray:
        aligned = rolled[:: self.block]
        return aligned[least_in_run(aligned, 1, self.run)]

    def probes(self, rolled: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(least_in_run(rolled, self.block, self.run))
        return at[in_bitmap(bitmap, rolled[at])]


def _longs(schema: pa.Schema, *columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _place(text: bytes, positions: np.ndarray) -> np.ndarray:
    """Word positions with 24 bits of the text above them, to tell rows that share an id apart."""
    return positions + ((zlib.crc32(text) & 0xFFFFFF) << 32)


def _indexing(finder: _Finder):
    schema = pa.schema([("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches):
            yield _longs(schema, [signed(finder.reference(rolled)) for _, _, rolled, _ in finder.documents(texts)])

    return run


def _probing(finder: _Finder, index: Broadcast):
    schema = pa.schema([("h", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            hits, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, _, rolled, _ in finder.documents(texts):
                hits.append(signed(np.unique(rolled[finder.probes(rolled, index.value)])))
                docs.append(np.full(len(hits[-1]), ids[i]))
            h, d = np.concatenate(hits), np.concatenate(docs)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
            upto = np.concatenate((edge[1:], [len(h)])) - 1 if len(h) else edge
            yield _longs(schema, [h[edge]], [d[edge]], [d[upto]])

    return run


def _extending(finder: _Finder, index: Broadcast, anchors: Broadcast):
    """Full windows around anchors: one row each, or with the others of the document in
    ``starts`` where the partition has already seen a smaller doc_id."""
    schema = pa.schema([("w", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("starts", pa.list_(pa.int64()))])

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        w, d, p = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        order = np.argsort(w, kind="stable")
        w, d, p = w[order], d[order], p[order]
        start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.concatenate((start, [len(w)]))))
        open_ = d == least
        yield pa.RecordBatch.from_arrays([pa.array(signed(w[open_])), pa.array(d[open_]), pa.array(p[open_]), pa.nulls(int(open_.sum()), schema.field("starts").type)], schema=schema)
        d, p = d[~open_], p[~open_]
        if len(d):
            order = np.argsort(d, kind="stable")
            d, p = d[order], p[order]
            start = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((start, [len(d)])).astype(np.int32)), pa.array(p))
            none = pa.nulls(len(start), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(d[start]), none, lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch, texts in text_blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            windows = None
            for i, begin, rolled, words in finder.documents(texts):
                at = finder.probes(rolled, index.value)
                at = at[in_bitmap(anchors.value, rolled[at])]
                if not len(at):
                    continue
                if windows is None:
                    windows, _ = words.windows(finder.window)
                count = len(rolled) + finder.block - finder.window
                mark = np.zeros(count + 1, dtype=np.int32)
                np.add.at(mark, np.clip(at - (finder.window - finder.block), 0, count), 1)
                np.add.at(mark, np.clip(at + 1, 0, count), -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                held.append((windows[begin + starts], np.full(len(starts), ids[i]), _place(texts[i], starts)))
                size += len(starts)
            if size > GATHER:
                yield from settled(held)
                size = 0
        if held:
            yield from settled(held)

    return run


def _words_left(text: bytes, starts: np.ndarray | None, window: int) -> tuple[int, np.ndarray | None, bytes]:
    words = text.split()
    if starts is None or not len(starts):
        return len(words), None, b" ".join(words)
    mark = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    gone = np.cumsum(mark[:-1]) > 0
    return len(words), gone, b" ".join([words[i] for i in np.flatnonzero(~gone)])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"


def _keeping(window: int, touched: Broadcast | None, texts_too: bool):
    """What is left of a document: without ``touched`` by its starts, else only where its bit is not set."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole
            if touched is not None:
                hit = in_bitmap(touched.value, batch.column("id_hash").to_numpy(zero_copy_only=False).view(np.uint64))
                batch = batch.filter(pa.array(~hit))
            for part, texts in text_blocks(iter([batch])):
                rows = []
                places = part.column("places") if touched is None else [None] * len(texts)
                for doc_id, text, found in zip(part.column("doc_id").to_pylist(), texts, places, strict=True):
                    starts = None
                    if found is not None and found.is_valid:
                        values = found.values.to_numpy(zero_copy_only=False)
                        own = values >> 32 == zlib.crc32(text) & 0xFFFFFF
                        starts = np.unique(values[own] & 0xFFFFFFFF)
                    n, gone, left = _words_left(text, starts, window)
                    spans = []
                    if gone is not None:
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]
                    rows.append((None if doc_id == LAST else doc_id, n, 0 if gone is None else int(gone.sum()), hashlib.sha256(left).hexdigest(), left if texts_too else None, spans))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept, spans`` of every row of ``docs``.

    A word goes if a window of ``window`` words covers it whose words also start in a
    document with a smaller doc_id, judged on the input.  ``kept`` has the words that
    stay, joined by one space (null with ``texts=False``); ``spans`` the removed runs as
    word numbers, end exclusive.  Null and empty texts have no words.  A null doc_id
    counts as larger than all others.  Rows that share an id do not remove each other;
    equal rows get equal results.  Further columns are not read.
    """
    context = docs.sparkSession.sparkContext
    finder = _Finder(window, block)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    index = context.broadcast(hashed_bitmap(rows.select("text").mapInArrow(_indexing(finder), "h long"), INDEX_BITS))
    hits = rows.mapInArrow(_probing(finder, index), "h long, low long, high long")
    shared = hits.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    anchors = context.broadcast(hashed_bitmap(shared.select("h"), ANCHOR_BITS))
    found = rows.mapInArrow(_extending(finder, index, anchors), "w long, doc_id long, place long, starts array<long>")
    # rows that are settled need no window; each gets a key of its own, so they do not meet in one task
    least = F.min("doc_id").over(Window.partitionBy("key", "settled"))
    dealt = found.select(F.coalesce("w", F.xxhash64("doc_id", "starts")).alias("key"), F.col("w").isNull().alias("settled"), "doc_id", "place", "starts")
    covered = dealt.withColumn("least", least).where(F.col("settled") | (F.col("doc_id") > F.col("least")))
    places = F.concat(F.collect_list("place"), F.flatten(F.collect_list("starts")))
    starts = checkpointed(covered.groupBy("doc_id").agg(places.alias("places")))
    touched = context.broadcast(hashed_bitmap(starts.select(F.xxhash64("doc_id")), DOCUMENT_BITS))
    hashed = rows.withColumn("id_hash", F.xxhash64("doc_id"))
    clean = hashed.mapInArrow(_keeping(window, touched, texts), RESULT)
    repeated = hashed.mapInArrow(_only(touched), "doc_id long, text binary").join(starts, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(_keeping(window, None, texts), RESULT)
    return clean.unionByName(repeated)


def _only(touched: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(touched.value, batch.column("id_hash").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit)).select(["doc_id", "text"])

    return run
