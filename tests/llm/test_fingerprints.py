import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from depgrove.llm import fingerprints
from depgrove.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def similarity(a, b):
    x, y = Counter(WORDS.findall(a)), Counter(WORDS.findall(b))
    top = sum(max(x[k], y[k]) for k in x | y)
    return sum(min(x[k], y[k]) for k in x | y) / top if top else 1.0


def following(rows):
    """The next distinct id's text of every row, around the ring (unique ids)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}


def check(spark, rows, docs):
    nxt, text = following(rows), {r[0]: r[1] or "" for r in rows}
    out = fingerprints.compare_with_next(docs).collect()
    assert len(out) == len(rows)
    errors = []
    for r in out:
        own, other = text[r["doc_id"]], nxt[r["doc_id"]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(r["near_edited"] - similarity(own, edited))
        errors.append(r["near_next"] - similarity(own, other))
    assert abs(sum(errors) / len(errors)) < 0.02
    assert max(map(abs, errors)) < 0.35
    return out


def test_table_agrees_with_true_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = check(spark, rows, docs)
    by_text = {}
    text = dict(rows)
    for r in out:
        assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len({r["fingerprint"] for r in out}) == len(set(text.values()))


def test_edge_cases(spark):
    rows = [(None, "null id here"), (4, None), (9, ""), (10, " \n\t"), (5_000, "é" * 7 + " zwei drei"), (90_000_000, "a b a b a"), (90_000_001, "word " * 60_000), (-3, "x")]
    docs = spark.createDataFrame([(*r, "key", 1) for r in rows], "doc_id long, text string, key string, half int")
    out = {r["doc_id"]: r for r in check(spark, rows, docs)}
    assert out[4]["fingerprint"] == "" and out[4]["near_next"] == 1.0
    assert fingerprints.compare_with_next(docs.limit(0)).collect() == []
    repeated = docs.unionByName(docs)
    assert fingerprints.compare_with_next(repeated).count() == 2 * len(rows)
    alone = fingerprints.compare_with_next(docs.where("doc_id = 5000")).first()
    assert alone["near_next"] == 1.0


def test_counts_of_words(spark):
    draw = random.Random(1)
    texts = [" ".join(draw.choices("abcdefg", k=n)) for n in (0, 1, 2, 5, 50)] + [" a\n\ta ", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in fingerprints.term_counts(rows, ["i"]).collect():
        got.setdefault(r["i"], []).append(r["weight"] if r["term"] is not None else None)
    for i, text in enumerate(texts):
        assert sorted(got[i], key=str) == (sorted(Counter(WORDS.findall(text)).values(), key=str) or [None])


def test_default_has_64_samples_and_wordless_texts_have_none(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, " \n"), (2, "")], "i int, text string")
    got = {r["i"]: len(r["sketch"]) for r in fingerprints.sketches(rows, ["i"]).collect()}
    assert got == {0: 64, 1: 0, 2: 0}


def test_main_path_is_native(spark, sf_dir):
    plan = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_a_value_is_exponential_with_the_weight_as_rate(spark):
    for weight in (1, 2, 5, 1000):
        rows = spark.range(20_000).select(F.xxhash64("id").alias("term"), F.lit(float(weight)).alias("w"), F.log(F.lit(float(weight))).alias("l"))
        cost = rows.select((-F.log(fingerprints.sample_value(F.col("term"), F.col("w"), F.col("l"), 3))).alias("x"))
        got = cost.agg(F.avg("x").alias("mean"), F.stddev("x").alias("spread")).first()
        assert abs(got["mean"] * weight - 1) < 0.05 and abs(got["spread"] * weight - 1) < 0.05


def test_texts_are_shuffled_once(spark, sf_dir):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    scans = len(re.findall(r"FileScan parquet \[[^\]]*\btext#", plan))
    assert scans == 1 and re.search(r"ReusedExchange \[[^\]]*\btext#", plan)
