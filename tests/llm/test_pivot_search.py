import numpy as np
import pytest

from depgrove.llm import pivot_search


def brute(ids, points, query, point, k):
    scores = [sum(int(a) * int(b) for a, b in zip(row, point)) for row in points]
    return sorted((-s, int(i)) for s, i in zip(scores, ids) if i != query)[:k]


@pytest.mark.parametrize("seed", range(12))
def test_slab_agrees_with_all_products(seed):
    draw = np.random.default_rng(seed)
    n, width = int(draw.integers(1, 400)), int(draw.integers(1, 9))
    centres = draw.integers(-900, 900, (5, width))
    points = (centres[draw.integers(0, 5, n)] + draw.integers(-40, 40, (n, width))).astype(float)
    points[draw.integers(0, n, n // 3)] = points[0]
    ids = draw.permutation(n * 2)[:n]
    pivots = pivot_search.spread_out(points, int(draw.integers(0, 9)))
    far = pivot_search.distances(points, pivots)
    slab = pivot_search.Slab(ids, points, far)
    for at in range(0, n, 7):
        found, scores = slab.best(int(ids[at]), points[at], far[at], 10)
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist())] == brute(ids, points, ids[at], points[at], 10)


def test_pivots_spare_evaluations():
    draw = np.random.default_rng(3)
    centres = draw.integers(-900, 900, (40, 16))
    points = (centres[draw.integers(0, 40, 8000)] + draw.integers(-9, 9, (8000, 16))).astype(float)
    far = pivot_search.distances(points, pivot_search.spread_out(points[:1000], 32))
    slab = pivot_search.Slab(np.arange(8000), points, far)
    for at in range(0, 8000, 400):
        found, scores = slab.best(at, points[at], far[at], 10)
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist())] == brute(range(8000), points, at, points[at], 10)
    assert slab.evaluated < 0.3 * 20 * 8000


def test_every_kind_of_row(spark):
    given = [
        (100, [0.5, -0.25]), (100, [0.5, -0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
        (7, [float("inf"), 0.0]), (None, [9.0, 9.0]), (200, []), (8, [0.0, -1.0]), (9, [2.0**40, 0.0]), (10, [3e300, -3e300]),
    ]
    vectors = spark.createDataFrame([(i, v, "q", 0.0) for i, v in given], "vec_id long, embedding array<double>, query_id string, score double")
    out = {}
    for r in pivot_search.nearest_of_each(vectors, k=10).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    big = 2**63 - 1
    assert sorted(out[100]) == [(1, 10, big), (2, 9, 2**59), (3, 1, 524288), (4, 1, 524288), (5, 2, 524288), (6, 8, 524288), (7, 3, 0), (8, 200, 0)]
    assert sorted(out[200]) == [(i + 1, v, 0) for i, v in enumerate([1, 1, 2, 3, 8, 9, 10, 100, 100])]
    assert set(out) == {100, 200}
    assert pivot_search.nearest_of_each(vectors.limit(0)).collect() == []


def test_slabs_and_batches_change_nothing(spark, sf_dir):
    vectors = pivot_search.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    index = pivot_search.build(vectors, 8)
    queries = index.where("vec_id % 25 = 0")
    one = pivot_search.search(index, queries, 3).collect()
    many = pivot_search.search(index, queries, 3, slab_rows=17).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 3 * queries.count()
