"""What must not grow with a table beside its rows: batches, rows for every line, repeated work."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depgrove.functions import text as tx
from depgrove.operators import batches, chunk_index, discover


def test_batches_are_cut_by_bytes():
    texts = ["a" * 400, None, "é" * 300, "b" * 5000, "", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["n", "text"])
    parts = list(batches.cut(iter([batch, batch.slice(0, 0)]), "text", 1000))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
    assert sum((p.column("text").to_pylist() for p in parts), []) == texts


def test_a_word_of_all_lines_is_one_row_of_a_section(spark, monkeypatch):
    lines = [f"- [svc-{i}](./svc-{i}.md)" for i in range(50)] + ["| svc-7 | x |", "it requires svc-9", "| svc-8 | requires |"]
    docs = spark.createDataFrame([("a", "# A\n\n## Dependencies\n\n" + "\n".join(lines))], "doc_id string, text string")
    lexicon = spark.createDataFrame([("md",), ("svc-7",), ("svc-8",), ("svc-9",), ("svc-9",)], "name string")
    rows = []
    join = type(docs).join

    def counted(self, other, *args, **more):
        if "name" in self.columns:
            rows.append(self.where("name = 'md'").count())
        return join(self, other, *args, **more)

    monkeypatch.setattr(type(docs), "join", counted)
    found = {(r["dst"], r["confidence"]) for r in discover.structural(docs, lexicon).collect()}
    assert rows == [1]
    assert found == {("md", 0.8), ("svc-7", 0.8), ("svc-8", 0.8), ("svc-9", 0.85)}


def test_triples_run_one_pattern_over_a_line(spark):
    rows = spark.createDataFrame([("a", 0, "9-Svc USES  the Db-1. x\ttalks to y; p is\tforwarded to q, r sends a request to s"), ("a", 1, "- [a](./a.md)"), ("a", 2, None)], "doc_id string, pos int, line string")
    found = discover.triples(rows)
    assert [(r["subject"], r["verb"], r["object"]) for r in found.collect()] == [("svc", "uses", "db-1"), ("x", "communicates with", "y"), ("p", "calls", "q"), ("r", "calls", "s")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and " RLIKE " not in plan.split("Generate")[-1].upper()


def test_every_verb_form_holds_a_stem(spark):
    said = ["depend on", "depended on", "requires", "call", "invokes", "use", "integrate with", "connect to", "provides", "expose", "exports", "communicates with", "talk to",
            "send a message to", "sends data to", "validates via", "authenticate through", "verifies using", "is submitted to", "is sent to", "is forwarded to", "is passed to"]
    rows = spark.createDataFrame([("a", i, f"x {v} y") for i, v in enumerate(said)], "doc_id string, pos int, line string")
    assert discover.triples(rows).count() == len(said)


@pytest.mark.parametrize(("path", "clean"), [("docs/a.md", "docs/a.md"), ("docs/./a.md", "docs/a.md"), ("docs/../a.md", "a.md"), ("/a", "a"), ("a//b", "a/b"), ("a/", "a"), ("", ""), ("..", ""), (".a/..b/...", ".a/..b/...")])
def test_plain_paths_are_left_alone(spark, path, clean):
    assert spark.createDataFrame([(path,)], "p string").select(tx.resolved_path(F.col("p"))).first()[0] == clean


def test_texts_of_single_ids_are_not_compared(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", None), (None, "z")], "doc_id string, text string")
    once = chunk_index._distinct(docs)
    assert sorted(map(tuple, once.collect())) == [("a", "x"), ("b", "")]
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()
    twice = chunk_index._distinct(docs.unionByName(spark.createDataFrame([("a", "w"), ("a", "y")], docs.schema)))
    assert sorted(map(tuple, twice.collect())) == [("a", "w"), ("b", "")]


def test_documents_shuffle_only_what_differs(spark, sf_dir):
    from depgrove.sources import derived

    plan = derived.component_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" not in plan.split("Exchange", 1)[1]


def counting(spark, column):
    """``column`` through a function that counts its calls, and the count."""
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    return F.udf(seen, "string")(column), calls


def test_keywords_of_a_name_are_looked_up_once(spark):
    from depgrove.operators import classify

    found = spark.createDataFrame([("redis cache db",)], "name string").select(classify.inferred_type(F.col("name")).alias("t")).select("t.type", "t.confidence")
    assert tuple(found.first()) == ("cache", 0.9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_max(") == 1


def test_lines_are_searched_once_for_names_that_meet(spark):
    line, calls = counting(spark, F.col("line"))
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "aa bb"), (1, 2, "cc"), (2, 0, "bb"), (2, 5, "aa"), (3, 0, "cc aa")], "doc_id long, pos int, line string")
    names = spark.createDataFrame([("aa",), ("bb",), ("cc",)], "name string")
    found = discover.cooccurrence(rows.withColumn("line", line), names).collect()
    assert sorted(map(tuple, found)) == [("aa", "bb", 0.55, 1, 1), ("aa", "cc", 0.55, 1, 1), ("bb", "cc", 0.55, 1, 1)]
    assert calls.value == rows.count()


def test_cross_reference_reads_its_signals_once(spark):
    from depgrove.operators import codescan

    of_file, calls = counting(spark, F.col("language"))
    one = lambda target, kind, of, language: ("s", target, of, kind, 0.9, "e", "f", 1, language)
    rows = spark.createDataFrame(
        [one("aws_db_instance.orders", "terraform_resource", "database", "terraform"), one("orders-db", "db_connection", "database", "python"), one("x", "env_var_ref", "cache", "terraform")],
        "source_component string, target_component string, target_type string, signal_type string, confidence double, evidence string, file_path string, line_number int, language string",
    )
    found = codescan.cross_referenced(rows.withColumn("language", of_file)).collect()
    assert [tuple(r) for r in found] == [("s", "orders-db", "aws_db_instance.orders", 0.7)]
    assert calls.value == rows.count()


def test_a_large_mapping_is_not_broadcast(spark, monkeypatch):
    from depgrove.operators import graph

    edges = spark.createDataFrame([("a", "b", "calls", 0.5), ("a", "c", "uses", 0.9), ("d", "b", "calls", 0.9), ("a", "d", "uses", 1.0)], "src string, dst string, type string, confidence double")
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "x")], "file string, component string")
    monkeypatch.setattr(graph, "BROADCAST", 3)
    found = graph.lifted(edges, files)
    assert [tuple(r) for r in found.collect()] == [("x", "y", 0.9, "uses", 3)]
    assert found._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") >= 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_signals_of_a_pair_are_moved_once(spark):
    from depgrove.operators import registry

    rows = spark.createDataFrame([("a", "b", "link", "x", 1.0, 1.0), ("a", "b", "link", "x", 0.5, 1.0), ("a", "b", "mention", "y", 0.7, 1.0), ("b", "a", "mention", "y", 0.7, 1.0), ("a", "a", "link", "x", 1.0, 1.0)], registry.SIGNALS)
    for parts in (None, 7):
        related = registry.relations(registry.united(rows, rows, parts=parts))
        assert exchanges(related) == 1
        assert sorted((r["src"], r["dst"], r["confidence"], sorted(r["by_kind"]), r["signals"]) for r in related.collect()) == [("a", "b", 1.0, ["link", "mention"], 2), ("b", "a", 0.7, ["mention"], 1)]


def test_documents_move_each_pair_of_keys_once(spark, sf_dir):
    from depgrove.sources import derived

    docs = derived.component_documents(spark, sf_dir)
    assert exchanges(docs) == 2 and "l_suppkey" not in docs._jdf.queryExecution().executedPlan().toString()


def test_links_and_names_that_are_not_merged_repeat(spark):
    text = "# A\n\n## Dependencies\n\n[b](./b.md) svc-1\n\n## Requires\n\nsvc-1\n"
    docs = spark.createDataFrame([("a", "a.md", text), ("b", "a.md", text)], "doc_id string, path string, text string")
    lexicon = spark.createDataFrame([("svc-1",)], "name string")
    paths = spark.createDataFrame([("b.md",)], "path string")
    assert [discover.link_edges(docs, paths, merged).count() for merged in (True, False)] == [1, 2]
    assert [discover.structural(docs, lexicon, merged).count() for merged in (True, False)] == [2, 4]


def test_the_type_of_the_most_certain_mention_stays(spark):
    rows = spark.createDataFrame([("a", 0, "x uses y"), ("a", 1, "x calls y"), ("a", 2, "x calls y"), ("a", 3, "p integrates with q"), ("a", 4, "p connects to q"), ("a", 5, "m uses n, m provides n")], "doc_id string, pos int, line string")
    assert sorted(map(tuple, discover.relations(rows).collect())) == [("m", "n", 0.7, "mentions", 2), ("p", "q", 0.65, "depends-on", 2), ("x", "y", 0.75, "calls", 3)]


@pytest.mark.parametrize("most_df", [None, 30])
def test_vectors_are_written_once_whatever_the_number_of_blocks(spark, monkeypatch, most_df):
    from depgrove.operators import search

    docs = spark.createDataFrame([(i, " ".join(["common"] * 2 + [f"w{i % p}" for p in (2, 3, 5, 7)])) for i in range(60)], "doc_id long, text string")
    post = search.postings(docs)
    rows = []

    def counted(df):
        done = written(df)
        rows.append((done.columns, done.count()))
        return done

    written = search.checkpointed
    monkeypatch.setattr(search, "checkpointed", counted)
    monkeypatch.setattr(search, "POSTINGS", 1 << 30)
    one, many = (search.similar_documents(post, 60, 0.4, most_df, block) for block in (1000, 2))
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert all(n < 60 for _, n in rows[1::2])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    by = {}
    for r in search.tfidf(post, 60).collect():
        by.setdefault(r["doc_id"], {})[r["term"]] = r["w"], r["df"]
    total = lambda a, b: round(sum(w * by[b][t][0] for t, (w, df) in by[a].items() if t in by[b] and df <= (most_df or 60)), 6)
    assert {(r["a"], r["b"]): round(r["similarity"], 5) for r in many.collect()} == {(a, b): round(total(a, b), 5) for a in by for b in by if a < b and total(a, b) >= 0.4}


def test_products_of_blocks_are_exact_in_pieces(monkeypatch):
    import numpy as np

    from depgrove.operators import search

    draw = np.random.default_rng(3)
    a, b = (np.where(draw.random((n, 50)) < np.linspace(0.02, 0.9, 50), draw.random((n, 50)), 0) for n in (17, 23))

    def part(x):
        t, doc = np.nonzero(x.T)
        return search._by_term(t, doc.astype(np.uint8), x[doc, t])

    for full, most in ((1_024, 2_000_000), (4, 1), (0, 7)):
        monkeypatch.setattr(search, "FULL_TERMS", full)
        monkeypatch.setattr(search, "PRODUCTS", most)
        x, y, s = search._products(part(a), part(b), 17, 23, 3.0)
        assert 0 < len(s) < 17 * 23
        assert sorted(zip(x, y)) == sorted(zip(*np.nonzero(a @ b.T >= 3.0))) and np.allclose(s, (a @ b.T)[x, y])
    assert len(search._products(part(a[:, :0]), part(b), 17, 23, 3.0)[2]) == 0


def test_planned_targets_are_searched_once_a_line(spark):
    import time

    from depgrove.operators import codescan

    plain = r"(?i)(?:TODO|FIXME|HACK|XXX)[:\s]++.*?(?<![\w.-])[.-]*+(\w[\w.-]*-(?:service|api|db|cache|queue|broker|cluster)[\w.-]*+)"
    texts = ["TODO a TODO: b-db FIXME c HACK d-api x", "TODO: none", "todo\ra-db", "TODO x TODO\r b-api", "TODO x XXXX:\r\rFIXME\u2028 c-queue.d", "XXXTODO a-b-cache-x TODO", "TODO\rTODO\ra-db TODO", "TODO: -a-db.TODO b-api", "fixme .a-service-db", "TODO x\x85TODO y-api", "TODO-db TODO"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    every = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
    for r in rows.select("t", every(plain).alias("a"), F.filter(every(codescan.TO_DO), lambda v: v != "").alias("b")).collect():
        assert r["a"] == r["b"], r["t"]
    assert rows.select(F.sum(F.size(every(plain)))).first()[0] >= 9
    begin = time.time()
    assert spark.createDataFrame([("TODO " * 20_000,)], "t string").select(F.size(every(codescan.TO_DO))).first()[0] == 1
    assert time.time() - begin < 10
