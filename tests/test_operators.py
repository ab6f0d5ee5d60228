import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depgrove.functions import evidence as conf
from depgrove.functions import text as tx
from depgrove.operators import changes, classify, codescan, discover, evidence, search, sections, vectors
from depgrove.sources import files


def test_tiers_and_noisy_or(spark):
    scores = [0.99, 0.95, 0.8, 0.6, 0.5, 0.43, 0.41, 0.1]
    got = [r["t"] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(conf.tier(F.col("s")).alias("t")).collect()]
    assert got == ["explicit", "explicit", "strong-inference", "moderate", "weak", "semantic", "threshold", "threshold"]
    pairs = [(0.6, 0.7, 0.88), (0.5, 0.5, 0.75), (0.8, 0.9, 0.98), (0.99, 0.99, 0.9999)]
    for r in spark.createDataFrame(pairs, "a double, b double, c double").select("c", conf.noisy_or(F.col("a"), F.col("b")).alias("d")).collect():
        assert abs(r["c"] - r["d"]) < 1e-9


def test_merging(spark):
    s = spark.createDataFrame([("a", "b", "code", 0.8, "calls", "x", 1.0), ("a", "b", "ner", 0.6, "mentions", "y", 2.0), ("a", "c", "llm", 0.55, "mentions", "z", 0.0)], "src string, dst string, algorithm string, confidence double, type string, evidence string, weight double")
    assert {(r["dst"], r["type"]) for r in evidence.merge_max(s).collect()} == {("b", "calls"), ("c", "mentions")}
    weighted = {r["dst"]: r["confidence"] for r in evidence.merge_weighted(s).collect()}
    assert weighted["b"] == round((0.8 * 0.85 + 0.6 * 0.5) / 1.35, 6)
    assert {r["dst"]: r["confidence"] for r in evidence.merge_registry(s).collect()} == {"b": 1.0, "c": 0.55}
    assert {r["dst"]: r["source_type"] for r in evidence.independent(s).collect()} == {"b": "both", "c": "markdown"}
    assert evidence.quality_gate(s).count() == 2
    assert evidence.merge_hybrid(s, 0.7).count() == 1


def test_text_functions(spark):
    one = spark.createDataFrame([("# The Title\n\nSee [docs](./a.md#x) and `code` of the e-mail-service.\n```\nx\n```", "d/e/f.md")], "text string, path string")
    r = one.select(tx.title(F.col("text"), F.col("path")).alias("t"), tx.stem(F.col("path")).alias("s"), tx.links(F.col("text")).alias("l"), tx.tokens(F.col("text")).alias("k"), tx.strip_markdown(F.col("text")).alias("p")).first()
    assert (r["t"], r["s"], r["l"]) == ("The Title", "f", ["./a.md"])
    assert "e-mail-service" in r["k"] and "the" not in r["k"]
    assert "`" not in r["p"] and "docs" in r["p"] and "a.md" not in r["p"]


def test_chunks_follow_headings(spark):
    text = "intro\n# A\na\n## B\nb\n# C\n### D\nd"
    docs = spark.createDataFrame([("x", text)], "doc_id string, text string")
    got = sorted((r["section"], r["start_line"], r["end_line"], r["heading_path"]) for r in sections.chunks(docs).collect())
    assert got == [(0, 1, 1, ""), (1, 2, 3, "A"), (2, 4, 5, "A > B"), (3, 6, 6, "C"), (4, 7, 8, "C > D")]


@pytest.mark.parametrize("value,host,kind", [("postgres://u:p@db.internal:5432/x", "db.internal", "database"), ("u:p@tcp(mysql-1:3306)/x", "mysql-1", "database"), ("host=pg port=5", "pg", "database"), ("mongodb+srv://u@m/x", "m", "database"), ("https://example.com/a", "", "service"), ("queue:9092", "queue", "unknown"), ("plain", "", "unknown")])
def test_connection_strings(spark, value, host, kind):
    r = spark.createDataFrame([(value,)], "v string").select(tx.connection_target(F.col("v")).alias("h"), tx.connection_type(F.col("v")).alias("t")).first()
    assert (r["h"], r["t"]) == (host, kind)


def test_relations_and_links(spark):
    docs = spark.createDataFrame([("a.md", "a.md", "checkout depends on billing. checkout calls the ledger.\n[b](b.md) [w](https://x.y)")], "doc_id string, path string, text string")
    found = {(r["src"], r["dst"]): r["type"] for r in discover.relations(tx.lines(docs)).collect()}
    assert found == {("checkout", "billing"): "depends-on", ("checkout", "ledger"): "calls"}
    assert [(r["dst"], r["confidence"]) for r in discover.link_edges(docs, docs.select("path")).collect()] == [("b.md", 0.5)]


@pytest.mark.parametrize("line,kind,confidence", [("a depended on the b.", "depends-on", 0.8), ("a invokes b", "calls", 0.75), ("a use b", "mentions", 0.7), ("a exposes b", "implements", 0.7), ("a talks to b", "depends-on", 0.65), ("a sends a request to b", "calls", 0.75), ("a verifies through b", "depends-on", 0.8), ("a is forwarded to b", "calls", 0.75), ("a reads from b", None, None)])
def test_forms_of_verbs(spark, line, kind, confidence):
    rows = discover.triples(tx.lines(spark.createDataFrame([(1, line)], "doc_id int, text string"))).collect()
    assert [(r["subject"], r["object"], r["type"], r["confidence"]) for r in rows] == ([("a", "b", kind, confidence)] if kind else [])


def test_infrastructure_in_prose(spark):
    text = "IAM\nWe use IAM and Postgres.\nredis, REDIS\n\nnot dockerised; docker is"
    rows = discover.infrastructure(tx.lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"))).collect()
    assert {(r["name"], r["type"], r["line"]) for r in rows} == {("iam", "service", 2), ("postgresql", "database", 2), ("redis", "cache", 3), ("docker", "orchestrator", 5)}


def test_search(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat mouse"), (3, "bird"), (4, None)], "doc_id int, text string")
    assert [r["doc_id"] for r in search.bm25(docs, ["cat"], 5).collect()] == [2, 1]
    assert search.bm25(docs, ["nothing"], 5).collect() == []
    post = search.postings(docs)
    assert {(r["a"], r["b"]) for r in search.similar_documents(post, 4, 0.1).collect()} == {(1, 2)}


def test_types_vectors_changes(spark):
    names = spark.createDataFrame([("orders-database",), ("redis",), ("gateway",), ("zzz",)], "n string")
    assert [r["t"]["type"] for r in names.select(classify.inferred_type(F.col("n")).alias("t")).collect()] == ["database", "cache", "gateway", "unknown"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert [(r["vec_id"], r["similarity"]) for r in vectors.nearest(v, 1, 2).collect()] == [(2, 1.0), (3, 0.0)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id int, text string"), spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "doc_id int, text string")
    assert {(r["doc_id"], r["change"]) for r in changes.changes(old, new).collect()} == {(2, "modified"), (3, "deleted"), (4, "added")}


def test_code_signals(spark):
    code = [("s", "s/app.py", "import redis\nr = redis.Redis(host='cache-1.internal')\nu = os.environ['ORDERS_URL']"), ("s", "s/app_test.go", 'sql.Open("postgres", "database/sql")'), ("s", "s/db.tf", 'resource "aws_db_instance" "main_db" {')]
    found = codescan.signals(spark.createDataFrame(code, "src string, path string, content string")).collect()
    assert {(r["signal_type"], r["target_component"]) for r in found} >= {("cache_client", "cache-1.internal"), ("env_var_ref", "ORDERS_URL"), ("terraform_resource", "aws_db_instance.main_db")}
    assert not any(r["file_path"].endswith("_test.go") for r in found)


def test_scan_save_and_load(spark, tmp_path):
    (tmp_path / "docs/.git").mkdir(parents=True)
    (tmp_path / "docs/vendor").mkdir()
    for name, text in (("docs/a.md", "# A\ntext"), ("docs/b.MD", "no heading"), ("docs/.git/c.md", "x"), ("docs/vendor/d.md", "x"), ("docs/e.txt", "x")):
        (tmp_path / name).write_text(text)
    found = {r["path"]: r["title"] for r in files.scan(spark, str(tmp_path / "docs")).collect()}
    assert found == {"a.md": "A", "b.MD": "b"}
    nodes = spark.createDataFrame([("a", ""), ("b", "cache")], "id string, component_type string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "x", 0.5)], "src string, dst string, confidence double")
    files.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.load_graph(spark, str(tmp_path / "g"))
    assert {r["component_type"] for r in n.collect()} == {"unknown", "cache"} and e.count() == 1


def test_every_query_runs(spark, sf_dir):
    from depgrove.plans.queries import QUERIES
    from depgrove.plans.oracles import ORACLES

    assert set(ORACLES) <= set(QUERIES)
    for name in ("impact_depth3", "merge_signals_max", "link_edges", "code_graph", "streamed_edges"):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_catalogs_are_whole(spark):
    assert len(classify.KEYWORDS) == 15 and sum(map(len, classify.KEYWORDS.values())) == 148
    names = spark.createDataFrame([(n,) for n in ("nginx", "consul", "kubernetes", "splunk", "cassandra", "kinesis", "edge-proxy", "ecr")], "n string")
    got = [r["t"]["type"] for r in names.select(classify.inferred_type(F.col("n")).alias("t")).collect()]
    assert got == ["load-balancer", "config-server", "orchestrator", "log-aggregator", "database", "message-broker", "load-balancer", "container-registry"]
    code = [
        ("a", "a/a.py", "from celery import Celery\napp = Celery('x')"), ("b", "b/b.py", "import boto3\nc = boto3.client('sqs')"), ("c", "c/c.ts", "import { Pool } from 'pg'\nconst p = new Pool()"),
        ("d", "d/d.go", 'import "github.com/nats-io/nats.go"\nnc, _ := nats.Connect("nats://n-1:4222")'), ("e", "e/e.tf", 'resource "aws_eks_cluster" "main" {'), ("f", "f/f.py", "import requests\nx = get('a')"),
    ]
    found = codescan.signals(spark.createDataFrame(code, "src string, path string, content string")).collect()
    assert {(r["source_component"], r["target_type"]) for r in found} == {("a", "message-broker"), ("b", "queue"), ("c", "database"), ("d", "message-broker"), ("e", "orchestrator")}


def test_every_turn_has_windows(spark, tmp_path):
    from depgrove.plans.queries import QUERIES

    rows = [(1, 0, "user", "a\nb"), (1, 1, "assistant", "z"), (1, 1, "assistant", "z"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["doc_id"], r["pos"]): r["text"] for r in QUERIES["line_windows_all"](spark, str(tmp_path)).collect()}
    assert got == {("1/0/1", 0): "a b", ("1/0/1", 1): "b", ("1/1/1", 0): "z", ("1/1/2", 0): "z"}


def test_nearest_to_each_agrees_with_nearest(spark, sf_dir):
    from depgrove.session import table

    v = table(spark, sf_dir, "embeddings")
    got = {}
    for r in vectors.nearest_to_each(v, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add((r["vec_id"], r["similarity"]))
    assert set(got) == {r["vec_id"] for r in v.where("vec_id % 100 = 0").collect()} and len(got) > 1
    for q in sorted(got)[:3]:
        assert got[q] == {(r["vec_id"], r["similarity"]) for r in vectors.nearest(v, q, 10).collect()}


def test_types_from_context_ties_and_seeds(spark):
    rows = [("elasticsearch", None, None), ("x", "My Cache", None), ("x", None, "postgres here"), ("x", "y", None), (None, None, None), ("Database", "", "")]
    names = spark.createDataFrame(rows, "n string, title string, head string")
    got = [(r["t"]["type"], r["t"]["confidence"]) for r in names.select(classify.inferred_type(F.col("n"), F.col("title"), F.col("head")).alias("t")).collect()]
    assert got == [("log-aggregator", 0.85), ("cache", 0.75), ("database", 0.70), ("unknown", 0.5), ("unknown", 0.5), ("database", 0.95)]
    seeds = [("redis*", "cache"), ("pay", "gateway"), ("red", "queue")]
    names = spark.createDataFrame([("Redis-1",), ("a-redis",), ("Payments",), ("none",), (None,)], "n string")
    got = [r["t"] and r["t"]["type"] for r in names.select(classify.seeded_type(F.col("n"), seeds).alias("t")).collect()]
    assert got == ["cache", "queue", "gateway", None, None]
    assert names.select(classify.seeded_type(F.col("n"), []).alias("t")).first()["t"] is None


def test_paths_of_links_and_noise(spark):
    paths = ["a/b/../y.md", "a/b/././z.md", "a/b/../../c.md", "../../x.md", "/a//b.md", "a/..", ""]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(tx.resolved_path(F.col("p"))).collect()]
    assert got == ["a/y.md", "a/b/z.md", "c.md", "x.md", "a/b.md", "", ""]
    docs = spark.createDataFrame([("d/e/f.md", "[x](../../g.md) [y](./h.md#top) [z](/i.md) [self](f.md) ![p](../q.png) [" + "[" * 50_000)], "path string, text string")
    found = {r["dst"]: r["confidence"] for r in discover.link_edges(docs, spark.createDataFrame([("g.md",)], "path string")).collect()}
    assert found == {"g.md": 1.0, "d/e/h.md": 0.5, "i.md": 0.5, "d/q.png": 0.5}
    nodes = spark.createDataFrame([("svc", "", "service")], "id string, title string, component_type string")
    edges = spark.createDataFrame([("svc", "the"), ("svc", "x"), ("svc", "api.example.io"), ("svc", "cache-1"), ("svc", "cache-1")], "src string, dst string")
    types = spark.createDataFrame([("cache-1", "cache"), ("cache-1", "queue")], "id string, component_type string")
    assert [(r["id"], r["component_type"]) for r in evidence.with_missing_nodes(nodes, edges, types).orderBy("id").collect()] == [("cache-1", "cache"), ("svc", "service")]


def test_registry_rows_of_a_pair_count_once(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 0.5)], "src string, dst string, type string, confidence double")
    registry = spark.createDataFrame([("a", "b", 0.6), ("a", "b", 0.9), ("c", "d", 0.7)], "src string, dst string, confidence double")
    assert sorted(map(tuple, evidence.with_registry(edges, registry).collect())) == [("a", "b", "calls", 0.9), ("c", "d", "mentions", 0.7)]


def test_similar_documents_hold_no_rows_of_pairs(spark):
    """Blocks of 7 documents, a term in all of them: the pairs of a plain join, and no join of documents with documents in the plan."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(["common", *(draw.choice(words[: 10 + i]) for _ in range(i % 9 * 3))])) for i in range(40)] + [(40, None), (41, "")]
    post = search.postings(spark.createDataFrame(docs, "doc_id long, text string"))
    by = {}
    for r in search.tfidf(post, 42).collect():
        by.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    want = {(a, b): sum(w * by[b].get(t, 0) for t, w in by[a].items()) for a in by for b in by if a < b}
    found = search.similar_documents(post, 42, 0.3, block=7)
    got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
    assert got and got.keys() == {p for p, s in want.items() if round(s, 6) >= 0.3} and all(abs(s - want[p]) < 1e-6 for p, s in got.items())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_to_each_holds_no_rows_of_pairs(spark):
    """Copies, ties, zero, short, empty and null vectors, no numbers: as by comparing all pairs, and no join in the plan."""
    draw = random.Random(3)
    rows = [(i, [round(draw.uniform(-1, 1), 1) for _ in range(3)]) for i in range(60)] + [(60 + i, [0.5, 0.5, 0.5]) for i in range(15)]
    rows += [(80, [0.0, 0.0, 0.0]), (81, [1.0]), (82, []), (83, None), (84, [1.0, None, 0.0]), (85, [float("nan"), 1.0, 0.0]), (86, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 5 == 0
    q = df.where(asks).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    s = df.crossJoin(q).where("vec_id != query_id").select("query_id", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("query")), 6).alias("similarity"))
    want = s.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where("at <= 6").drop("at")
    for blocks in (None, 1):
        found = vectors.nearest_to_each(df, asks, 6, blocks)
        text = lambda d: sorted(map(str, d.collect()))
        assert text(found) == text(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
