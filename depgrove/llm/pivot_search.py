"""Exact search for the largest inner products by a table of distances to pivots.

Every vector keeps its distances to some pivots.  For a query q and a vector x the
triangle inequality makes the largest difference of their distances to a pivot a lower
bound of their distance, and as q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 an upper bound of
their product.  Candidates are evaluated in the order of that bound until no bound
reaches the k-th best product found, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgrove.llm.common import checkpointed, give_back

#: Vectors of which the pivots are chosen: a bounded sample, in the order of a hash of the id.
SAMPLE = 2048
PIVOTS = 32
#: Components are floor(SCALE * x).
SCALE = 1024
#: Vectors of one slab, which a task holds while the queries pass.
SLAB_ROWS = 65_536
LEAST_SLAB = 1024
#: Candidates of the first evaluation; the next ones double.
FIRST = 64
#: Squared norms below this have products that are exact as doubles.
EXACT = float(1 << 52)

INDEX = "vec_id long, point array<double>, far array<double>"


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """The lists of a column as rows of doubles, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    wide = max(width, int(sizes.max(initial=0)))
    if len(flat) == len(sizes) * wide:
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots; not finite where they cannot be told."""
    width = max(points.shape[1], pivots.shape[1])
    points, pivots = widened(points, width), widened(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.square(points).sum(axis=1)[:, None] + np.square(pivots).sum(axis=1) - 2 * points @ pivots.T
        return np.sqrt(np.maximum(squares, 0))


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Pivots: the row farthest from the mean, then each time the row farthest from those chosen."""
    with np.errstate(over="ignore"):
        points = points[np.square(points).sum(axis=1) < EXACT]
    if not len(points):
        return np.zeros((0, points.shape[1]))
    chosen = [int(np.argmax(distances(points, points.mean(axis=0, keepdims=True))[:, 0]))]
    least = distances(points, points[chosen])[:, 0]
    while len(chosen) < count and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vector``: the rows with an id and a vector of finite components."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(broken, F.lit(False)))


def build(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, scale: int = SCALE) -> DataFrame:
    """The pivot table of ``vec_id, vector``: scaled, rounded-down points and their distances to the pivots.

    The pivots come from ``sample`` vectors at most, every vector is indexed.
    """
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).select("vector").toArrow()
    centres = spread_out(np.floor(scale * matrix(some.column("vector"))), pivots)
    given = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("vector").value_lengths())
            with np.errstate(over="ignore"):
                points = np.floor(scale * matrix(batch.column("vector")))
            far = distances(points, given.value)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            inside = np.arange(points.shape[1]) < sizes[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(points[inside])), pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1], pa.array(far.ravel()))],
                names=["vec_id", "point", "far"],
            )

    return vectors.mapInArrow(run, INDEX)


class Slab:
    """Vectors of one slab with what the bounds need."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, far: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.far = ids[order], points[order], far[order]
        with np.errstate(over="ignore"):
            self.squares = np.square(self.points).sum(axis=1)
        self.plain = self.squares < EXACT
        self.evaluated = 0

    def products(self, at: np.ndarray, point: np.ndarray, square: float) -> np.ndarray:
        """Exact inner products of rows ``at`` with a query, kept within 64 bits."""
        self.evaluated += len(at)
        width = max(len(point), self.points.shape[1])
        rows, point = widened(self.points[at], width), np.pad(point, (0, width - len(point)))
        if square < EXACT and self.plain[at].all():
            return (rows @ point).astype(np.int64)
        whole = [int(x) for x in point]
        exact = (sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in rows.tolist())
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], dtype=np.int64)

    def best(self, query_id: int, point: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best rows with other ids, larger products first, then smaller ids."""
        with np.errstate(over="ignore", invalid="ignore"):
            square = float(np.square(point).sum())
            gap = np.abs(self.far - far).max(axis=1, initial=0.0)
            both = self.squares + square
            bound = (both - np.square(gap)) / 2 + 1 + 1e-12 * both  # the last terms cover rounding
        bound[~self.plain | ~np.isfinite(bound)] = np.inf
        if square >= EXACT:
            bound[:] = np.inf
        left = np.flatnonzero(self.ids != query_id)
        best = np.zeros(0, dtype=np.int64)
        scores = np.zeros(0, dtype=np.int64)
        size = max(FIRST, k)
        if len(left) > size:
            head = left[np.argpartition(-bound[left], size - 1)[:size]]
        else:
            head = left
        best, scores = self._merge(best, scores, head, point, square, k)
        floor = scores[k - 1] if len(scores) >= k else -np.inf
        seen = np.zeros(len(self.ids), dtype=bool)
        seen[head] = True
        rest = left[(bound[left] >= floor) & ~seen[left]]
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        at = 0
        while at < len(rest) and (len(scores) < k or bound[rest[at]] >= scores[k - 1]):
            best, scores = self._merge(best, scores, rest[at : at + size], point, square, k)
            at, size = at + size, 2 * size
        return self.ids[best], scores

    def _merge(self, best: np.ndarray, scores: np.ndarray, at: np.ndarray, point: np.ndarray, square: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        best, scores = np.concatenate([best, at]), np.concatenate([scores, self.products(at, point, square)])
        order = np.lexsort((best, ~scores))[:k]  # rows are in the order of ids; ~ turns the order round
        return best[order], scores[order]


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slab, vectors before queries; queries are answered as they pass."""
        slab, parts, built = None, [], None
        for batch in batches:
            slabs = batch.column("slab").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((slabs[1:] != slabs[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(slabs)], strict=True):
                piece = batch.slice(a, b - a)
                if slabs[a] != slab:
                    slab, parts, built = slabs[a], [], None
                if not asks[a]:
                    parts.append((piece.column("vec_id").to_numpy(), matrix(piece.column("point")), matrix(piece.column("far"))))
                    continue
                if not parts:
                    continue  # a slab without vectors
                if built is None:
                    width = max(p.shape[1] for _, p, _ in parts)
                    built = Slab(np.concatenate([p[0] for p in parts]), np.concatenate([widened(p[1], width) for p in parts]), np.concatenate([p[2] for p in parts]))
                    parts = parts[:1]
                ids = piece.column("vec_id").to_numpy()
                found = [built.best(q, point, far, k) for q, point, far in zip(ids.tolist(), matrix(piece.column("point")), matrix(piece.column("far")), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                    names=["query_id", "vec_id", "score"],
                )
        give_back()

    return run


def search(index: DataFrame, queries: DataFrame, k: int, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``index`` with the largest products for each of ``queries``.

    Both have the columns of ``build``.  The vectors are dealt into slabs of about
    ``slab_rows`` by a hash of the id; the queries visit every slab, one after the other,
    so a task holds one slab and one batch of queries whatever their number.  Rows with
    the query's own id are left out; ties go to the smaller id.
    """
    session = index.sparkSession
    rows = index.count()
    slabs = max(-(-rows // slab_rows), min(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_SLAB)), 1)
    held = index.select(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(slabs)).cast("int").alias("slab"), F.lit(False).alias("asks"), "vec_id", "point", "far")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(True).alias("asks"), "vec_id", "point", "far")
    dealt = held.unionByName(asked).repartition(slabs, "slab").sortWithinPartitions("slab", "asks")
    found = dealt.mapInArrow(_scan(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_each(vectors: DataFrame, step: int = 100, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``step``, against all rows.

    Scores are integer inner products of floor(1024 * x).  Rows without an id and vectors
    that are null or hold null or non-finite components take no part; an empty vector
    takes part and scores 0, a shorter one counts as filled with zeros.  Of several rows
    with a query's id the least vector asks, and none of them is its candidate; other
    repeated rows all count.  Products beyond 64 bits become the nearest 64-bit number.
    Other columns are not read; an empty table gives an empty result.
    """
    index = checkpointed(build(usable(vectors), pivots))
    queries = index.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min(F.struct("point", "far")).alias("x")).select("vec_id", "x.point", "x.far")
    return search(index, queries, k)
