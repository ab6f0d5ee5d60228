"""Dense vectors: cosine, nearest to one query or to each of a set, centroids, placeholders."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length, empty ones and zero vectors."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size)


def nearest(vectors: DataFrame, query_id, k: int = 10) -> DataFrame:
    """``vec_id, similarity`` of the k vectors nearest to one of them, itself left out."""
    query = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("query")).limit(1)
    scored = vectors.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(query))  # one row
    return scored.select("vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("similarity")).orderBy(F.col("similarity").desc(), "vec_id").limit(k)


#: Vectors in a block, blocks of rows at least, products that a task holds at once.
BLOCK, LEAST_BLOCKS, PRODUCTS = 32_768, 8, 2_000_000
#: Places of similarities that are no number and of those that are null, above and below all others; of a row beside itself.
NAN, NULL, SELF = 3.0, -3.0, -9.0


def nearest_to_each(vectors: DataFrame, is_query: Column, k: int = 10, blocks: int | None = None) -> DataFrame:
    """``query_id, vec_id, similarity`` of the k vectors nearest to each row that ``is_query`` holds for, itself left out.

    Every block of queries meets every block of rows in a task of its own, as a product
    of two matrices; the k best of a query leave it, then the blocks' best are compared.
    The work grows with queries times rows, the memory of a task does not.  ``vec_id`` is
    unique; ``blocks`` sets the number of blocks of rows.
    """
    given = vectors.where("vec_id IS NOT NULL")
    size = given.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    across, down = blocks or max(LEAST_BLOCKS, -(-size["n"] // BLOCK)), max(1, -(-size["q"] // BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = given.select("vec_id", "embedding", F.lit(False).alias("asks"), dealt(across).alias("i")).select("*", every(down).alias("j"))
    queries = given.where(is_query).select("vec_id", "embedding", F.lit(True).alias("asks"), dealt(down).alias("j")).select("vec_id", "embedding", "asks", every(across).alias("i"), "j")
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def best(rows: pa.Table) -> pa.Table:
        x, y, s = _best(rows, k)
        ids = rows["vec_id"].combine_chunks()
        return pa.table({"query_id": ids.take(pa.array(x)), "vec_id": ids.take(pa.array(y)), "similarity": pa.array(s, mask=np.equal(s, NULL))})

    scored = rows.unionByName(queries).groupBy("i", "j").applyInArrow(best, f"query_id {kind}, vec_id {kind}, similarity double")
    scored = scored.withColumn("similarity", F.round("similarity", 6))
    order = [F.col("similarity").desc(), F.col("vec_id")]
    return scored.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("at") <= k).select("query_id", "vec_id", "similarity")


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up from left to right as ``dot`` does."""
    total = np.zeros(len(a))
    for at in range(a.shape[1]):
        total += a[:, at] * b[:, at]
    return total


def _rounded(values: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero by the decimal text, as Spark rounds."""
    scaled = np.abs(values) * 1e6
    out = np.floor(scaled + 0.5)
    for at in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[at] = int(Decimal(repr(abs(float(values[at])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, values) + 0.0


def _best(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of the k rows nearest to each, with their cosine."""
    asks, lists = rows["asks"].to_numpy(), rows["embedding"].combine_chunks()
    ids = rows["vec_id"].combine_chunks()
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)  # of equal ids, a query and its own row, the same rank
    ordered = ids.take(pa.array(order))
    rank[order] = np.concatenate([[0], np.cumsum(pc.not_equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False))]) if len(order) else []
    start, values = lists.offsets.to_numpy(), lists.values
    empty = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False) | (empty[start[1:]] > empty[start[:-1]]), 0, np.diff(start))
    flat = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    queries, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, PRODUCTS // max(1, len(others)))
    by = {}
    for n in np.unique(size[size > 0]):
        whole = np.flatnonzero(size == n)
        each = flat[start[whole][:, None] + np.arange(n)]
        by[n] = whole, each, np.sqrt(_summed(each, each))
    for at in range(0, len(queries) if len(others) else 0, step):
        some = queries[at : at + step]
        near = np.full((len(some), len(rows)), NULL)
        with np.errstate(all="ignore"):
            for whole, each, length in by.values():
                mine = np.flatnonzero(np.isin(some, whole))
                p = np.searchsorted(whole, some[mine])
                norm = length[p][:, None] * length[None, :]
                s = (each[p] @ each.T) / norm
                near[np.ix_(mine, whole)] = np.where(np.isnan(norm), NAN, np.where(norm > 0, np.where(np.isnan(s), NAN, s), NULL))
        near = near[:, others]
        near[rank[some][:, None] == rank[others][None, :]] = SELF
        least = np.partition(near, -k, axis=1)[:, -k] if len(others) > k else np.full(len(some), SELF)
        x, y = np.nonzero((near >= least[:, None] - 3e-6) & (near > SELF))
        value = near[x, y]
        real = np.flatnonzero((value != NAN) & (value != NULL))
        q, r = some[x[real]], others[y[real]]
        for n, (whole, each, length) in by.items():
            here = size[q] == n
            a, b = np.searchsorted(whole, q[here]), np.searchsorted(whole, r[here])
            value[real[here]] = _summed(each[a], each[b]) / (length[b] * length[a])
        millionths = _rounded(value)
        sort = np.lexsort((rank[others[y]], -millionths, x))
        x, y, value = x[sort], y[sort], value[sort]
        first = np.searchsorted(x, np.arange(len(some)))
        kept = np.arange(len(x)) - first[x] < k
        out.append((some[x[kept]], others[y[kept]], value[kept]))
    x, y, s = (np.concatenate(parts) for parts in zip(*out))
    return x, y, np.where(s == NAN, np.nan, s)


def centroids(vectors: DataFrame) -> DataFrame:
    """``label, place, value``: mean vector of every label in long form."""
    each = vectors.select("label", F.posexplode("embedding").alias("place", "x"))
    return each.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


DIMENSION = 384


def placeholder(nodes: DataFrame, kind: str = "description") -> DataFrame:
    """``id, embedding``: a deterministic unit vector from a node's text, for tests without a model.

    The SHA-256 of the text gives four signed words in turn; the place is mixed in by
    exclusive or, and the vector is scaled to length one.
    """
    text = F.concat_ws("|", F.lit(kind), *[F.coalesce(c, F.lit("")) for c in ("id", "type", "component_type", "title")])
    digest = F.sha2(text, 256)
    # a word of 16 hex digits as a signed long: two halves, since one conversion would overflow
    half = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("long")
    word = lambda k: F.shiftleft(half(16 * k + 1), 32).bitwiseOR(half(16 * k + 9))
    words = F.array(*[word(k) for k in range(4)])
    rows = nodes.withColumn("digest", digest).withColumn("words", words)
    raw = F.transform(F.sequence(F.lit(0), F.lit(DIMENSION - 1)), lambda i: F.get("words", F.pmod(i, F.lit(4))).bitwiseXOR(i.cast("long")).cast("double") / float((1 << 63) - 1))
    rows = rows.withColumn("raw", raw)
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("size", size).select("id", F.when(F.col("size") > 0, F.transform("raw", lambda x: x / F.col("size"))).otherwise(F.col("raw")).alias("embedding"))
