from pyspark.sql import functions as F

from depgrove.operators import entities

DOC = "path string, title string, text string"


def test_components_come_from_ordered_evidence(spark):
    docs = spark.createDataFrame([
        ("a/user_service.md", "The Users", "# User Service\nProvides: Login API, sessions.txt, ,\n"), ("b/README.md", "R", "1. Order Service - x\n* **Pay Gateway**: y\n3) No Service\n- plain\n# Read me"),
        ("c/order-service-notes.md", "O", "text"), ("d/x.md", "X", None), (None, "N", "# N API"), ("e/login.md", "L", "# Login API {#top}\n## Other Service"),
    ], DOC)
    got = {r["id"]: (r["name"], r["type"], r["file"]) for r in entities.components(docs).collect()}
    assert got == {
        "user-service": ("The Users", "service", "a/user_service.md"), "login-api": ("Login API", "api", "a/user_service.md"), "sessions": ("sessions.txt", "unknown", "a/user_service.md"),
        "order-service": ("Order Service", "service", "c/order-service-notes.md"), "pay-gateway": ("Pay Gateway", "api", None), "order-service-notes": ("O", "service", "c/order-service-notes.md"),
    }
    assert entities.components(docs.limit(0)).collect() == []


def test_every_stage_decides(spark):
    known = spark.createDataFrame([("user-service", ["people"]), ("user-api", ["people", "x"]), ("order", []), ("a-very-long-name", []), ("b-very-long-name", []), ("db", [])], "id string, aliases array<string>")
    texts = ["User Service", "user", "order backend", "People", "very-long", "the user-service box", "odb", "xdbx", "abc", "", None, "User_Service.md", "nothing"]
    got = {r["text"]: (r["id"], r["stage"]) for r in entities.matched(spark.createDataFrame([(t,) for t in texts], "text string"), known).collect()}
    assert got == {
        "User Service": ("user-service", "id"), "User_Service.md": ("user-service", "id"), "user": ("user-service", "ending"), "order backend": ("order", "ending"), "People": ("user-api", "alias"),
        "very-long": ("a-very-long-name", "inside"), "the user-service box": ("user-service", "inside"), "xdbx": ("db", "inside"),
    }


def test_sentences_leave_fences_and_headings(spark):
    text = "# Heading depends on x\nOne thing is here. Two of v1.2 are here! short\n```\nin the fence it is.\n```\n~~~\nalso in the fence\n~~~ x\n1. **Listed** `item` text here\n```\nnever closed text"
    rows = entities.sentences(spark.createDataFrame([("a", "", text), ("b", "", None), ("c", "", "")], DOC)).orderBy("pos", "n").collect()
    assert [r["sentence"] for r in rows] == ["One thing is here.", "Two of v1.2 are here!", "Listed item text here"]


def test_triples_of_several_words(spark):
    said = [
        "The order desk depends on the payment api.", "aa calls b, c-d invokes e f; g uses (h)", "x requires y service now", "It uses things", "Same calls same", "one [two](u.md) talks to [three](v.md)", "p sends a request to q and calls r",
    ]
    rows = entities.triples(spark.createDataFrame([("p", i, 0, s) for i, s in enumerate(said)], "path string, pos int, n int, sentence string")).collect()
    assert sorted((r["pos"], r["subject"], r["verb"], r["object"]) for r in rows) == [
        (0, "The order desk", "depends on", "payment"), (1, "aa", "calls", "b"), (1, "c-d", "calls", "e f"), (2, "x", "requires", "y service now"), (5, "one two", "communicates with", "three"),
        (6, "p", "calls", "q and calls r"), (6, "p sends a request to q and", "calls", "r"),
    ]


def test_relations_between_documents(spark):
    docs = spark.createDataFrame([
        ("cart-service.md", "Cart", "Somebody calls the billing api.\nStores baskets in the Cache Database.\nIt needs the cart service.\nuses nothing"), ("billing-api.md", "Billing", "```\nbilling calls cart\n```"),
        ("cache.md", "", "# Cache Database"), ("z.md", None, None),
    ], DOC)
    got = sorted((r["src"], r["dst"], r["type"], r["confidence"]) for r in entities.relations(docs).collect())
    assert got == [("cart-service.md", "billing-api.md", "calls", 0.75), ("cart-service.md", "cache.md", "depends-on", 0.65)]
    assert entities.relations(docs.limit(0)).collect() == []


def test_long_runs_take_linear_time(spark):
    runs = ["cart uses " * 30_000, "a-" * 100_000, "- " * 100_000, "```\n" * 50_000, "[" * 20_000, "a " * 100_000, "is. " * 50_000, "# " * 100_000]
    docs = spark.createDataFrame([(f"{i}.md", "", t) for i, t in enumerate(runs)], DOC)
    assert entities.triples(entities.sentences(docs)).count() >= 1
    assert entities.components(docs).agg(F.count(F.lit(1))).first()[0] == 0
