from pyspark.sql import functions as F

from depgrove.functions import text as tx
from depgrove.operators import chunk_index, discover, sections

DOC = "doc_id string, text string"


def test_chunks_follow_the_headings():
    rows = sections.chunk_rows("intro\n  # Top ##\na\n### Deep\nb\n## Next #\n#no\n####### seven\n# \n")
    assert [(r["section"], r["start_line"], r["end_line"], r["heading_path"]) for r in rows] == [
        (0, 1, 1, ""), (1, 2, 3, "Top"), (2, 4, 5, "Top > Deep"), (3, 6, 10, "Top > Next"),
    ]
    assert rows[1]["content"] == "  # Top ##\na" and sections.chunk_rows(" \n\t") == [] and sections.chunk_rows("") == []
    assert [r["heading_path"] for r in sections.chunk_rows("# A\n# B")] == ["A", "B"]


def test_tree_hangs_headings_under_shallower_ones():
    rows = sections.tree_rows("\nfirst\n# A\n\n## B\n" + "x" * 300 + "\n#### C\n## D\n#\n")
    assert [(r["section"], r["parent"], r["level"], r["heading"], r["line_start"], r["line_end"]) for r in rows] == [
        (0, None, 0, "", 0, 9), (1, 0, 1, "A", 2, 3), (2, 1, 2, "B", 4, 5), (3, 2, 4, "C", 6, 6), (4, 1, 2, "D", 7, 7), (5, 0, 1, "", 8, 9),
    ]
    assert rows[0]["summary"] == "first" and rows[2]["summary"] == "x" * 200 and rows[1]["summary"] == ""
    assert sections.tree_rows("# Only")[0]["summary"] == "Only" and len(sections.tree_rows("")) == 1


def test_long_documents_take_linear_time(spark):
    docs = spark.createDataFrame([("a", "# h\n" * 20_000), ("b", "#" * 1_000_000), ("c", "\n" * 1_000_000), ("d", None), ("d", None)], DOC)
    assert {r["doc_id"]: r["n"] for r in sections.chunks(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 20_000, "b": 1}
    assert {r["doc_id"]: r["n"] for r in sections.tree(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 20_001, "b": 1, "c": 1, "d": 2}


def told(index):
    return (
        sorted(map(tuple, index.chunks().select("chunk_id", "heading_path", "chunk_len", "content").collect())), sorted(map(tuple, index.postings().select("term", "chunk_id", "tf").collect())),
        sorted(map(tuple, index.frequencies().collect())), tuple(index.size().first()), [tuple(r) for r in index.search(["cache", "redis", "alpha", "cache"], 5).collect()],
    )


def test_an_updated_index_is_the_index_of_the_new_documents(spark, tmp_path):
    a = spark.createDataFrame([("a", "# Alpha\ncache redis\n## More\nredis redis"), ("b", "alpha cache"), ("c", "gone"), ("e", "same text"), (None, "x"), ("n", None)], DOC)
    b = spark.createDataFrame([("a", "# Alpha\ncache only"), ("b", "alpha cache"), ("d", "new alpha"), ("e", "same text"), ("f", " ")], DOC)
    index = chunk_index.ChunkIndex(spark, f"file://{tmp_path}/one")
    assert index.version == 0 and index.search(["alpha"]).collect() == [] and tuple(index.size().first()) == (0, 0)
    assert index.update(a) == 1
    before = told(index)
    assert index.update(b, spark.createDataFrame([("c",), ("n",), ("d",), ("nobody",)], "doc_id string")) == 2
    fresh = chunk_index.ChunkIndex(spark, f"file://{tmp_path}/two")
    fresh.update(b)
    assert told(index) == told(fresh) != before
    # unchanged documents were not written again
    assert {r["doc_id"] for r in index._read("docs").where("version = 2").collect()} == {"a", "c", "d", "f", "n"}
    assert index.compact() == 3 and told(index) == told(fresh)
    index.update(a)
    fresh.update(a)
    assert told(index) == told(fresh)
    assert {r["doc_id"]: r["version"] for r in index.documents().collect()}["c"] == 4


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    index = chunk_index.ChunkIndex(spark, f"file://{tmp_path}/i")
    index.update(spark.createDataFrame([("a", "alpha")], DOC))
    before = told(index)

    with monkeypatch.context() as patch:
        patch.setattr(chunk_index, "MANIFEST", "no schema at all")
        try:
            index.update(spark.createDataFrame([("b", "beta")], DOC))
        except Exception:
            pass
    assert told(index) == before
    assert index.update(spark.createDataFrame([("b", "beta")], DOC)) == 2 and index.chunks().count() == 2


def test_long_runs_in_text_functions(spark):
    runs = ["a-" * 500_000, "a" * 1_000_000, " " * 1_000_000, "\n" * 1_000_000, "x uses " + "a" * 1_000_000, "-" * 1_000_000, "7" * 1_000_000, "uses " * 200_000]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(runs)], DOC)
    lines = tx.lines(docs)
    counts = docs.select(F.size(tx.tokens(F.col("text"))).alias("n"), tx.title(F.col("text"), F.lit("p/x.md")).alias("t"), F.length(tx.strip_markdown(F.col("text"))).alias("c"), F.size(tx.links(F.col("text"))).alias("l")).collect()
    assert [r["n"] for r in counts] == [1, 1, 0, 0, 2, 0, 1, 200_000] and {r["t"] for r in counts} == {"x"}
    assert discover.triples(lines).where("doc_id = '4'").count() == 1
    assert discover.infrastructure(lines).count() == 0
