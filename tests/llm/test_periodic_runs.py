import hashlib
import random
import zlib

import pytest

from depgrove.llm import periodic_runs, queries


def brute(words, shortest=12):
    """Maximal stretches of every period, each with its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(shortest, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def rows(found):
    return [[tuple(x) for x in text.tolist()] for text in found]


@pytest.mark.parametrize("seed", range(30))
def test_runs_agree_with_every_period(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(8):
        words = [b"%d" % x for x in draw.choices(range(draw.choice([1, 2, 3, 6])), k=draw.randint(0, 90))]
        if words:
            a = draw.randrange(len(words))
            p = draw.randint(1, len(words) - a)
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        texts.append(words)
    for shortest in (2, 5, 12):
        assert rows(periodic_runs.word_runs(texts, shortest)) == [brute(w, shortest) for w in texts]


def test_long_runs_take_no_square_time():
    assert rows(periodic_runs.word_runs([[b"a"] * 300_000])) == [[(0, 300_000, 1)]]
    assert rows(periodic_runs.word_runs([[b"%d" % (i % 1000) for i in range(100_500)]])) == [[(0, 100_500, 1000)]]
    assert rows(periodic_runs.word_runs([[b"a"] * 30 + [b"b"] + [b"a"] * 12, []])) == [[(0, 30, 1), (31, 12, 1)], []]


def test_every_kind_of_row(spark):
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    given = [(1, None), (2, ""), (3, " \n\t "), (4, "x\x0by " * 8), (4, "x\x0by " * 8), (None, "b " * 11), (5, long), (6, "one two three")]
    docs = spark.createDataFrame([(i, t, "runs", 1) for i, t in given], "doc_id long, text string, runs string, n_words int")
    out = sorted((tuple(r) for r in periodic_runs.periodic_runs(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = [(i, n, [tuple(r) for r in runs], kept if i != 5 else len(kept.split())) for i, n, runs, kept in out]
    assert got == [
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 16, [(0, 16, 2)], "x y"), (4, 16, [(0, 16, 2)], "x y"),
        (5, 20_000, [(0, 20_000, 5000)], 5000), (6, 3, [], "one two three"), (None, 11, [], " ".join("b" * 11)),
    ]
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_query_against_every_period(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    planted = 0
    for row in queries.op11_branching_tandems(spark, sf_dir).collect():
        words = (texts[row["doc_id"]] or "").encode().split()
        h = zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert tuple(row)[1:] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
        )
    assert planted > 10
