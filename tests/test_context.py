import pytest

from depgrove.operators import context
from depgrove.sources import derived


def test_documents_around_a_component_under_a_budget(spark):
    edges = spark.createDataFrame([("payment", "auth", 0.9), ("payment", "user", 0.8), ("web", "payment", 0.7), ("far", "web", 0.5)], "src string, dst string, confidence double")
    docs = spark.createDataFrame([("payment", "p" * 10), ("auth", "a" * 10), ("user", "u" * 10), ("web", ""), ("far", "f" * 10), ("other", "o"), ("nobody", None)], "id string, text string")
    rows = lambda *given: sorted((r["distance"], r["id"], r["text"], r["cut"]) for r in context.documented(edges, "payment", docs, *given).collect())
    assert rows(1, 25) == [(0, "payment", "p" * 10, False), (1, "auth", "a" * 10, False), (1, "user", "u" * 5, True)]
    assert rows(1, 20) == [(0, "payment", "p" * 10, False), (1, "auth", "a" * 10, False)] and rows(1, 1) == [(0, "payment", "p", True)]
    assert [r[1] for r in rows(2, 1000)] == ["payment", "auth", "user", "far"]
    assert context.documented(edges, "nobody", docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="budget"):
        context.documented(edges, "payment", docs, 1, 0)
    got = sorted(map(tuple, context.related(edges, "payment", 1).collect()))
    assert got == [("payment", "auth", "depends_on", 0.9), ("payment", "user", "depends_on", 0.8), ("payment", "web", "used_by", 0.7)]


def test_larger_tables_go_to_more_tasks(spark, sf_dir, monkeypatch):
    few = derived.part_edges(spark, sf_dir)
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(derived, "ROWS", 700)
    many = derived.part_edges(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert many.rdd.getNumPartitions() == -(-n // 700) > 4 and sorted(map(str, many.collect())) == want
