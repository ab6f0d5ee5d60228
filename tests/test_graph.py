import pytest
from pyspark.sql import functions as F

from depgrove.operators import graph

EDGES = "src string, dst string, type string, confidence double, source_type string"
G1 = [
    ("payment-api", "primary-db", "depends-on", 0.95, "markdown"), ("payment-api", "redis-cache", "depends-on", 0.85, "code"), ("auth-service", "primary-db", "depends-on", 0.90, "both"),
    ("auth-service", "payment-api", "depends-on", 0.70, "markdown"), ("web-frontend", "auth-service", "depends-on", 0.80, ""), ("web-frontend", "payment-api", "depends-on", 0.75, "code"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(G1, EDGES)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_impact_and_dependencies(edges):
    assert rows(graph.impact(edges, "primary-db"), "id", "distance") == [("auth-service", 1), ("payment-api", 1)]
    assert rows(graph.impact(edges, "primary-db", None), "id", "distance") == [("auth-service", 1), ("payment-api", 1), ("web-frontend", 2)]
    assert rows(graph.dependencies(edges, "payment-api"), "id", "confidence_tier") == [("primary-db", "explicit"), ("redis-cache", "strong-inference")]
    assert rows(graph.impact(edges, "primary-db", None, 0.92), "id") == [("payment-api",)]
    assert rows(graph.dependencies(edges, "web-frontend", 1, source_type="code"), "id") == [("payment-api",)]
    assert rows(graph.dependencies(edges, "nobody", None), "id") == []
    with pytest.raises(ValueError):
        graph.impact(edges, "primary-db", source_type="text")


def test_impact_is_dependencies_of_the_reversed_graph(edges):
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence", "source_type")
    assert rows(graph.impact(edges, "primary-db", None), "id", "distance") == rows(graph.dependencies(back, "primary-db", None), "id", "distance")


def test_cycles_and_paths(spark, edges):
    assert graph.cycles(edges, 4).collect() == []
    cyclic = edges.unionByName(spark.createDataFrame([("primary-db", "payment-api", "calls", 0.6, "code")], EDGES))
    assert rows(graph.cycles(cyclic, 4), "cycle", "length") == [(["payment-api", "primary-db", "payment-api"], 2)]
    found = graph.k_shortest(edges, "web-frontend", "primary-db", 2)
    assert [r["route"] for r in found.orderBy("rank").collect()] == ["web-frontend>auth-service>primary-db", "web-frontend>payment-api>primary-db"]
    assert graph.closure(edges).count() == 9


def test_ring_of_500(spark):
    ring = spark.range(500).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") + 1) % 500).alias("dst"), F.lit("calls").alias("type"), F.lit(0.9).alias("confidence"), F.lit("code").alias("source_type"))
    assert graph.dependencies(ring, "n0", 5).count() == 5
    assert graph.closure(ring).count() == 250_000


def test_warnings_and_stats(spark, edges):
    nodes = spark.createDataFrame([(n,) for n in ("payment-api", "auth-service", "web-frontend", "primary-db", "lonely")], "id string")
    assert rows(graph.orphans(nodes, edges), "id") == [("lonely",)]
    assert rows(graph.dangling(nodes, edges), "src", "dst") == [("payment-api", "redis-cache")]
    assert graph.pruned(nodes, edges).count() == 5
    empty = graph.stats(nodes.limit(0), edges.limit(0)).first()
    assert (empty["nodes"], empty["edges"], empty["quality_score"]) == (0, 0, 0.0)
    assert sum(r["edges"] for r in graph.tier_distribution(edges).collect()) == 6
    assert rows(graph.degrees(edges).where("id = 'payment-api'"), "incoming_edges", "outgoing_edges") == [(2, 2)]


def test_a_far_reach_takes_few_rounds(spark, monkeypatch):
    """Chains, a ring with two doors, branches, parallel ways, rings and ends that nothing leads to: distances as by levels."""
    chain = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(300)]
    ring = [(f"r{i:03d}", f"r{(i + 1) % 200:03d}") for i in range(200)]
    doors = [("a299", "r000"), ("a300", "r150"), ("a010", "b"), ("b", "a090"), ("a290", "r190"), ("r020", "a005"), ("r033", "t1"), ("t1", "t2"), ("r033", "t2"), ("t2", "r100")]
    lost = [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "r007"), ("y1", "y2"), ("y2", "r050"), ("x2", "z")]
    pairs = chain + ring + doors + lost
    want, level, n = {"a000": 0}, ["a000"], 0
    while level:
        n += 1
        level = sorted({b for a, b in pairs if a in level} - set(want))
        want |= dict.fromkeys(level, n)
    written, write = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(1) or write(df))
    found = graph.reach(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("a000",)], "id string"))
    assert {r["id"]: r["distance"] for r in found.collect()} == want and found.count() == len(want)
    assert max(want.values()) > 300 and len(written) < 80
