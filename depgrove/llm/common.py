"""Helpers that several operators share: tables, checkpoints, vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgrove.session import checkpointed, shared_folder, table

__all__ = ["checkpointed", "shared_folder", "table"]

#: Bytes of text that the numpy helpers take at a time.
CHUNK_BYTES = 1 << 20
#: A word is a run of characters other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = 0x9E3779B97F4A7C15
_WINDOW_MULTIPLIER = 0xC2B2AE3D27D4EB4F


def word_count(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _space_table() -> np.ndarray:
    space = np.zeros(256, dtype=bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return space


IS_SPACE = _space_table()
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a block of texts: places in the joined bytes, 64-bit hashes, owners.

    ``first[i]`` is the index of text i's first word, ``first[-1]`` the word count.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            raw = LOWER[raw]
        self.raw = raw
        space = IS_SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.start, begins)
        n = len(raw)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[raw] * powers(_MULTIPLIER, n)[:n], out=sums[1:])
        inverse = powers(pow(_MULTIPLIER, -1, 2**64), n)
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the words i..i+size-1 for every i, and whether they lie in one text."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * powers(_WINDOW_MULTIPLIER, n)[:n], out=sums[1:])
        inverse = powers(pow(_WINDOW_MULTIPLIER, -1, 2**64), n)
        rolled = mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1] + np.uint64(size))
        owner = self.owners()
        return rolled, owner[size - 1 :] == owner[: n - size + 1]


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task stays small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


_kept: dict[str, object] = {}


def kept(key: str, build):
    """What ``build()`` made for ``key`` in this worker; the one before it is dropped."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    """Drop what an operator before has kept in this worker."""
    _kept.clear()
    give_back()


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about CHUNK_BYTES of text (one text at least).

    The column is binary or string; null counts as empty.
    """
    for batch in batches:
        values = batch.column(column)
        if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
            values = values.cast(pa.binary() if not pa.types.is_large_string(values.type) else pa.large_binary())
        at = 0
        while at < batch.num_rows:
            texts, held, upto = [], 0, at
            while upto < batch.num_rows and (upto == at or held < CHUNK_BYTES):
                text = values[upto].as_py() or b""
                texts.append(text)
                held += len(text) + 1
                upto += 1
            yield batch.slice(at, upto - at), texts
            at = upto
        give_back()


def hashed_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places (31 at most) with two bits for every key.

    ``keys`` has one column of well-mixed longs; the places are their low bits and the
    bits from 32 on.  Spark ORs the buckets; the driver receives 2**bits / 8 bytes
    whatever the input, so the result may be broadcast.  A false hit is possible: use
    it where that costs work, never where it changes a result.
    """
    name = keys.columns[0]
    mask = F.lit((1 << bits) - 1)
    places = F.array(F.col(name).bitwiseAND(mask), F.shiftrightunsigned(F.col(name), 32).bitwiseAND(mask))
    placed = keys.where(F.col(name).isNotNull()).select(F.explode(places).alias("place"))
    buckets = placed.select(F.shiftrightunsigned("place", 15).alias("bucket"), F.col("place").bitwiseAND(F.lit(32767)).alias("at"))
    parts = buckets.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
    for part in parts:
        chunk = np.frombuffer(part["bits"], dtype=np.uint8)
        begin = part["bucket"] * 4096
        out[begin : begin + 4096] = chunk[: len(out) - begin]
    return out


#: The largest bitmap that is broadcast: 2**28 places are 32 MB, enough for 33 million keys.
MOST_BITS = 28


def sized_bitmap(keys: DataFrame, count: int, most_bits: int = MOST_BITS) -> np.ndarray | None:
    """A bitmap of at least eight places for each of ``count`` keys; None where it would exceed the bound of what is broadcast."""
    bits = max(10, (8 * count - 1).bit_length())
    return hashed_bitmap(keys, bits) if bits <= most_bits else None


def marked(df: DataFrame, column: str, keys: DataFrame, count: int, inside: bool = True, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose long ``column`` is among the ``count`` well-mixed ``keys`` (``inside=False``: all others).

    Few keys go to all tasks as a bitmap, which may let a few more rows in (and out of the
    others); more keys than that are joined.  Every row is on one of the two sides.
    """
    bitmap = sized_bitmap(keys, count, most_bits)
    if bitmap is None:
        return df.join(keys.withColumnRenamed(keys.columns[0], column).distinct(), column, "left_semi" if inside else "left_anti").select(*df.columns)
    given = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(given.value, batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(run, df.schema)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of uint64 keys are set."""
    mask = np.uint64(len(bitmap) * 8 - 1)
    out = _bit(bitmap, keys & mask)
    some = np.flatnonzero(out)
    out[some] = _bit(bitmap, (keys[some] >> np.uint64(32)) & mask)
    return out


def _bit(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (least node) of an undirected graph, by alternating stars.

    Each round hangs every node under the least neighbour it knows; the tables are
    written after each round, and the number of rounds is logarithmic in the path length.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = checkpointed(edges)
    while True:
        sizes = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes")).first()
        if sizes["n"] == sizes["nodes"] and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))  # all are stars
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go under the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its lower neighbours go under the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u != v").distinct())
