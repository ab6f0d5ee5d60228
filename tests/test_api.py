import json

import pytest

from depgrove import api
from tests.test_graph import EDGES, G1


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [("payment-api", "service"), ("auth-service", "service"), ("web-frontend", "service"), ("primary-db", "database"), ("redis-cache", "cache")]
    mentions = spark.createDataFrame([("payment-api", "docs/payment.md", "Payment > API", "explicit-link", 0.95), ("payment-api", "docs/x.md", "X", "ner", 0.5)], "component_id string, file_path string, heading_hierarchy string, detected_by string, confidence double")
    return api.Engine(spark, spark.createDataFrame([(n, "document", n, t) for n, t in nodes], "id string, type string, title string, component_type string"), spark.createDataFrame(G1, EDGES), mentions=mentions)


def test_queries(engine):
    assert {r["name"] for r in engine.impact("primary-db", "all").collect()} == {"payment-api", "auth-service", "web-frontend"}
    row = engine.impact("primary-db", most_mentions=1).where("name = 'payment-api'").first()
    assert row["mention_count"] == 2 and [m["file_path"] for m in row["mentions"]] == ["docs/payment.md"]
    best = engine.path("web-frontend", "primary-db").first()
    assert best["nodes"] == ["web-frontend", "auth-service", "primary-db"] and best["total_confidence"] == 0.72
    assert engine.path("web-frontend", "web-frontend").collect() == []
    assert [r["name"] for r in engine.list("service").collect()] == ["auth-service", "payment-api", "web-frontend"]
    assert engine.info()["relationship_count"] == 6
    assert engine.similar("payment-api", 2).count() == 2


def test_errors_and_json(engine):
    with pytest.raises(api.QueryError) as e:
        engine.impact("payment")
    assert e.value.code == "NOT_FOUND" and "payment-api" in e.value.suggestions
    with pytest.raises(api.QueryError):
        api.depth_of("deep")
    out = json.loads(api.to_json("impact", {"component": "redis-cache"}, lambda: engine.impact("redis-cache")))
    assert out["metadata"]["count"] == 1 and out["results"][0]["name"] == "payment-api"
    assert json.loads(api.to_json("impact", {}, lambda: engine.impact("")))["error"]["code"] == "MISSING_ARG"
    assert api.to_dot(engine.edges).startswith("digraph")


def test_build_from_documents(spark):
    docs = spark.createDataFrame([("a.md", "a.md", "A", "See [b](b.md)."), ("b.md", "b.md", "B", "nothing")], "doc_id string, path string, title string, content string")
    built = api.Engine.build(spark, docs)
    assert {(r["src"], r["dst"]) for r in built.edges.collect()} == {("a.md", "b.md")}
    assert built.search("nothing", 3).first()["doc_id"] == "b.md"
