import random

from pyspark.sql import functions as F

from depgrove.operators import cycles, graph

PAIR = "src string, dst string"


def brute(pairs):
    """Node to members of its component, by reachability."""
    nodes = sorted({n for p in pairs for n in p})
    after = {n: {b for a, b in pairs if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        reach[n] = seen
    return {n: sorted({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}


def components(spark, pairs, kind=PAIR):
    return {r["id"]: (r["component"], r["size"]) for r in cycles.strongly_connected(spark.createDataFrame(pairs, kind)).collect()}


def test_components_agree_with_reachability(spark):
    pairs = []
    for seed in range(6):
        draw = random.Random(seed)
        nodes = [f"{seed}-{i:02d}" for i in range(14)]
        pairs += [(draw.choice(nodes), draw.choice(nodes)) for _ in range((8, 14, 18, 22, 30, 45)[seed])]
    got = components(spark, pairs)
    assert got == {n: (m[0], len(m)) for n, m in brute(pairs).items()}


def test_a_long_ring_with_tails_and_a_dense_core(spark):
    ring = [(f"r{i:04d}", f"r{(i + 1) % 150:04d}") for i in range(150)]
    tails = [("in1", "in2"), ("in2", "r0005"), ("r0010", "out1"), ("out1", "out2")]
    core = [(f"c{i}", f"c{(i * k + 1) % 9}") for i in range(9) for k in (1, 2, 3)]
    got = components(spark, [*ring, *tails, *core, ("r0001", "c0"), ("x", "x"), ("x", None)])
    assert all(got[a] == ("r0000", 150) for a, _ in ring)
    want = brute(core)
    assert all(got[n] == (m[0], len(m)) for n, m in want.items())
    assert got["in1"] == ("in1", 1) and got["out2"] == ("out2", 1) and got["x"] == ("x", 1)
    assert components(spark, [(None, None)]) == {}


def test_edges_tags_and_classes(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("s", "a"), ("t", "b"), ("z", "s")]
    edges = spark.createDataFrame(pairs, PAIR)
    assert sorted((r["src"], r["dst"], r["component"]) for r in cycles.cyclic_edges(edges).collect()) == [("a", "b", "a"), ("a", "b", "a"), ("b", "a", "a"), ("c", "c", "c")]
    starts = spark.createDataFrame([("s",)], "id string")
    tags = {(r["src"], r["dst"]): (r["distance"], r["relationship"]) for r in cycles.traversed(edges, starts).collect()}
    assert tags == {
        ("s", "a"): (0, "direct-dependency"), ("a", "b"): (1, "cyclic-dependency"), ("b", "a"): (2, "cyclic-dependency"), ("b", "c"): (2, "direct-dependency"), ("c", "c"): (3, "cyclic-dependency"),
    }
    assert {(r["src"], r["dst"]) for r in cycles.traversed(edges, starts, 1).collect()} == {("s", "a")}
    scored = edges.withColumn("confidence", F.lit(0.9))
    kinds = lambda *ids: {r["component"]: (r["members"], r["kind"]) for r in cycles.crawl_cycles(scored, spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert kinds("s") == {"a": (["a", "b"], "cross_branch"), "c": (["c"], "cross_branch")}
    assert kinds("a") == {"a": (["a", "b"], "direct"), "c": (["c"], "cross_branch")}


def test_crawl_in_every_direction(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("c", "a")], PAIR).withColumn("confidence", F.lit(0.9))
    starts = spark.createDataFrame([("b",)], "id string")
    rows = lambda way, depth: sorted((r["id"], r["depth"], r["parents"], r["edges_out"]) for r in graph.crawl(edges, starts, way, depth).collect())
    assert rows("forward", None) == [("a", 2, ["c"], 1), ("b", 0, [], 1), ("c", 1, ["b"], 1)]
    assert rows("backward", 1) == [("a", 1, ["b"], 1), ("b", 0, [], 1), ("d", 1, ["b"], 1)]
    assert rows("both", 1) == [("a", 1, ["b"], 1), ("b", 0, [], 1), ("c", 1, ["b"], 1), ("d", 1, ["b"], 1)]


def simple_paths(pairs, a, b):
    found, todo = [], [[a]]
    while todo:
        path = todo.pop()
        for x, y in pairs:
            if x == path[-1] and y not in path:
                (found if y == b else todo).append([*path, y])
    return sorted(found, key=lambda p: (len(p), ">".join(p)))


def test_shortest_paths_have_no_cap(spark):
    line = [(f"n{i:02d}", f"n{i + 1:02d}", 0.9) for i in range(12)]
    edges = spark.createDataFrame(line, "src string, dst string, confidence double")
    assert [r["hops"] for r in graph.k_shortest(edges, "n00", "n12", 3).collect()] == [12]
    assert graph.k_shortest(edges, "n05", "n01", 3).collect() == [] and graph.k_shortest(edges, "n05", "n05", 3).collect() == [] and graph.k_shortest(edges, "n05", "nobody", 3).collect() == []
    assert graph.k_shortest(edges, "n00", "n12", 3, 5).collect() == []
    for seed in (1,):
        draw = random.Random(seed)
        nodes = [f"v{i}" for i in range(9)]
        pairs = sorted({(a, b) for a in nodes for b in draw.sample(nodes, 2) if a != b})
        edges = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "src string, dst string, confidence double")
        for k in (7, 1000):
            got = [r["path"] for r in graph.k_shortest(edges, "v0", "v5", k).orderBy("rank").collect()]
            assert got == simple_paths(pairs, "v0", "v5")[:k]


def test_paths_of_a_grid_of_130_nodes(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{(i * 3 + j * 7 + 1) % 130:03d}", 0.8) for i in range(130) for j in range(8)], "src string, dst string, confidence double")
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    found = graph.k_shortest(edges, "n000", "n127", 5).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and len({tuple(r["path"]) for r in found}) == 5
    assert all((a, b) in pairs for r in found for a, b in zip(r["path"], r["path"][1:]))
    assert [r["hops"] for r in found] == sorted(r["hops"] for r in found) and found[0]["hops"] == graph.reach(edges, spark.createDataFrame([("n000",)], "id string")).where("id = 'n127'").first()["distance"]


def test_runs_of_chains_go_in_few_rounds(spark):
    n = 3000
    ring = spark.createDataFrame([(f"r{i:04d}", f"r{(i + 1) % n:04d}") for i in range(n)], PAIR)
    rest, rounds = cycles._spliced(ring)
    assert rest.isEmpty() and len(rounds) <= 14  # by independent nodes alone it takes about 20
    got = {tuple(r) for r in cycles.strongly_connected(ring).select("component", "size").collect()}
    assert got == {("r0000", n)}


def test_graphs_of_long_chains_agree_with_reachability(spark):
    pairs, draw = [], random.Random(3)
    for part in range(4):
        for e in range((6, 9, 12, 16)[part]):
            a, b = (f"{part}-n{draw.randrange(7)}" for _ in range(2))
            between = [f"{part}-e{e}-{i}" for i in range(draw.choice((0, 1, 2, 7, 15, 16, 17, 18, 40)))]
            draw.shuffle(between)
            pairs += list(zip([a, *between], [*between, b]))
    pairs += [(f"s{k}-{i}", f"s{k}-{(i + 1) % k}") for k in (2, 3, 4, 5) for i in range(k)]
    assert components(spark, pairs) == {n: (m[0], len(m)) for n, m in brute(pairs).items()}
    numbers = {n: i for i, n in enumerate(sorted({n for p in pairs for n in p}))}
    counted = [(numbers[a], numbers[b]) for a, b in pairs]
    assert components(spark, counted, "src long, dst long") == {n: (m[0], len(m)) for n, m in brute(counted).items()}
