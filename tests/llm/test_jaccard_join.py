import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from depgrove.llm import jaccard_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, key long"


def shingles(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Union of all pairs at 0.75 or more, by comparing every pair."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = draw.choices(words, k=60)
    base = [draw.choices(words, k=draw.choice([3, 8, 20, 60, 150])) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 8])):
            at = draw.randrange(len(text))
            text[at : at + draw.choice([0, 1, 1])] = draw.choices(words, k=draw.choice([0, 1, 2])) or []
            if not text:
                text = ["only"]
        if draw.random() < 0.3:
            text = common[: draw.choice([20, 40, 60])] + text
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else "\n".join(text), "x", i))
    return rows


@pytest.mark.parametrize("seed,frequent", [(1, 16), (2, 2), (3, 3)])
def test_agrees_with_all_pairs(spark, seed, frequent):
    rows = corpus(seed, 240)
    rows += [(1000, None, "x", 0), (1001, "", "x", 0), (1002, "  \t", None, 0), (1003, "one two", "x", 0), (1004, "ONE two", "x", 0), (None, "one two", "x", 0), (5, "long " * 3 + " ".join(map(str, range(30_000))), "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, jaccard_join.Join(docs, frequent=frequent).result().collect()), key=str)
    assert got == brute(rows)


def test_a_large_group_of_near_copies_keeps_every_link(spark):
    draw = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6])):
            text[draw.randrange(120)] = f"e{draw.randrange(40)}"
        rows.append((i, " ".join(text), "x", i))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.near_duplicates(docs).collect() == []
    assert jaccard_join.first_of_each(docs).columns == ["doc_id", "text", "lang", "key"]
    assert jaccard_join.first_of_each(docs).collect() == []


def test_one_of_each_component_stays(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(3, text, "x", 1), (2, text + " more", "x", 1), (9, "", "x", 1), (9, "", "x", 1), (7, None, "x", 1), (2, text + " more", "x", 1)]
    out = jaccard_join.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in out) == [2, 7, 9, 9]


def test_signatures_of_linked_sets_meet():
    draw = random.Random(5)
    for n in (2, 3, 4, 5, 9, 30, 200, 1000):
        for fill in (1.0, 0.0, 0.5):  # all shared shingles frequent, all rare, either
            for _ in range(20):
                a = [f"t{draw.randrange(10**9)}" for _ in range(n + 4)]
                b = a[: len(a) - draw.randrange(n // 8 + 2)] + [f"u{i}" for i in range(draw.randrange(n // 9 + 1))]
                sets = jaccard_join.Sets([" ".join(a).encode(), " ".join(b).encode()])
                both, either = np.intersect1d(sets[0], sets[1]), np.union1d(sets[0], sets[1])
                if len(either) > len(both) and 4 * len(both) >= 3 * len(either):
                    held = {t: 16 if draw.random() < fill else draw.randrange(2, 16) for t in both.tolist()}  # by how many sets; the others by one
                    for t in either.tolist():
                        if t not in held:
                            held[t] = 16 if draw.random() < fill / 2 else draw.randrange(1, 16)
                    out = []
                    for i in range(2):
                        order = np.array(sorted(sets[i].tolist(), key=lambda t: (held[t], t)), dtype=np.uint64)
                        counts = [held[t] for t in order.tolist()]
                        out.append(jaccard_join.signatures(order, counts.count(1), sum(c < 16 for c in counts)))
                    bounds = [max(out[0][2][i], out[1][2][j]) + min(sets.sizes[0] - out[0][1][i], sets.sizes[1] - out[1][1][j]) - 1 for i in range(len(out[0][0])) for j in np.flatnonzero(out[1][0] == out[0][0][i])]
                    assert bounds and max(bounds) >= len(both)


def test_sketches_never_rule_out_a_link(spark):
    draw = np.random.default_rng(3)
    pairs = []
    for n in (2, 7, 31, 64, 300, 2000):
        for extra in (0, 1, n // 9, n // 4):
            a = draw.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate((a[extra // 2 :], draw.integers(0, 1 << 63, extra).astype(np.uint64)))
            pairs.append((a, b, 0, extra + extra // 2))
            pairs.append((b, a, 0, extra + extra // 2))
    a, b = draw.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    pairs.append((a, b, 3000, 10_000))
    # one has twice the places, or four times
    pairs.append((a[:140], a[:120], 0, 20))
    pairs.append((a[:120], b[:140], 60, 260))
    pairs.append((a[:60], a[:300], 0, 0))
    rows = [(jaccard_join.parity(a).tolist(), jaccard_join.parity(b).tolist(), low, high) for a, b, low, high in pairs]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, low int, high int").select(jaccard_join.apart(F.col("a"), F.col("b")).alias("places"), "low", "high")
    for r in df.collect():
        assert r["low"] <= r["places"] <= r["high"]


def test_many_unlinked_texts_around_one_passage(spark):
    """A passage that makes up 70 to 90 per cent of many texts: some link, most do not, and one third are copies."""
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(400):
        own = [f"o{i}x{k}" for k in range(draw.choice([4, 12, 20, 30]))]
        rows.append((i, " ".join(passage + own) if i % 3 else " ".join(passage), "x", i))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_rows_are_looked_up_by_a_join_beyond_the_bound_of_a_bitmap(spark):
    from pyspark.sql import functions as F

    from depgrove.llm.common import marked

    rows = spark.range(100).select("id", F.xxhash64("id").alias("h"))
    keys = rows.where("id < 40").select("h")
    for most in (28, 1):
        assert {r["id"] for r in marked(rows, "h", keys, 40, most_bits=most).collect()} >= set(range(40))
        inside = marked(rows, "h", keys, 40, most_bits=most).count()
        assert inside + marked(rows, "h", keys, 40, inside=False, most_bits=most).count() == 100
    assert inside == 40


def test_clashing_column_names(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.sql(f"SELECT doc_id, IF(doc_id = 5, 'else where', '{text}') AS text, 1 AS least, 2 AS most, 3 AS kept_id, 4 AS at, 5 AS row, 6 AS own_id, 7 AS id_hash, map('a', 1) AS stays, 8 AS rows FROM VALUES (4L), (3L), (3L), (5L), (NULL) AS t(doc_id)")
    out = jaccard_join.first_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 5]
    assert out.first()["stays"] == {"a": 1}


def test_sets_by_definition():
    texts = ["", "one", "a b c d", "A b c d e", "a b c d e f a b c d e g", " \n"]
    sets = jaccard_join.Sets([t.encode() for t in texts])
    assert sets.sizes.tolist() == [len(shingles(t)) for t in texts]
    assert len(set(sets.keys.tolist())) == 5  # the two empty ones share a key
    assert all((np.diff(sets[i].astype(object)) > 0).all() for i in range(len(texts)))
