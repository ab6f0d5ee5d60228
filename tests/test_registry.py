from pyspark.sql import functions as F

from depgrove.operators import registry


def test_registry_of_several_sources(spark, tmp_path):
    nodes = spark.createDataFrame([("b/Auth-Service.md", "Auth"), ("a/auth-service.md", "First"), ("db.md", "Orders DB"), (None, "x"), ("folder/", "no file")], "id string, title string")
    known = registry.components(nodes)
    assert sorted(map(tuple, known.collect())) == [("auth-service", "First", "service", "a/auth-service.md"), ("db", "Orders DB", "database", "db.md")]
    assert [r["id"] for r in registry.named(known, "ORDERS db").collect()] == ["db"]
    edge = lambda rows: spark.createDataFrame(rows, "src string, dst string, confidence double")
    links = registry.signals(edge([("a/auth-service.md", "db.md", 0.9), ("a/auth-service.md", "b/Auth-Service.md", 1.0), ("", "db.md", 1.0)]), "link", F.col("dst"))
    said = registry.signals(edge([("auth-service", "db", 0.4), ("auth-service", "db", 0.6), ("db", "x", 0.7)]), "mention", F.lit("said"), 2.0)
    rows = registry.united(links, said, links)
    out = {(r["src"], r["dst"]): r for r in registry.relations(rows).collect()}
    assert set(out) == {("auth-service", "db"), ("db", "x")}
    both = out["auth-service", "db"]
    assert both["confidence"] == 1.0 and both["signals"] == 2
    assert {k: tuple(v) for k, v in both["by_kind"].items()} == {"link": (1, 0.9, "db.md"), "mention": (1, 0.6, "said")}
    assert registry.relations(registry.united(rows, rows)).collect() == registry.relations(rows).collect()
    weightless = rows.withColumn("weight", F.lit(0.0))
    assert [(r["src"], r["confidence"]) for r in registry.at_least(registry.relations(weightless), 0.8).collect()] == [("auth-service", 0.9)]
    assert [tuple(r) for r in registry.node_edges(registry.relations(rows), known).collect()] == [("a/auth-service.md", "db.md", 1.0)]
    registry.save(known, rows, f"{tmp_path}/r")
    a, b = registry.load(spark, f"{tmp_path}/r")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, known.collect())) and sorted(map(tuple, b.collect())) == sorted(map(tuple, rows.collect()))
    assert registry.relations(rows.limit(0)).collect() == []
