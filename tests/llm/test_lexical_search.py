import math
import random
import re

import pytest

from depgrove.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda x: x[0].lower(), text or ""))


def brute(docs, items, k):
    """All scores of all documents, from the definition."""
    split = [(i, terms(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n_docs, n_terms = len(split), sum(len(t) for _, t in split)
    holding = {}
    for _, t in split:
        for x in set(t):
            holding[x] = holding.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in split:
            m = 10 + 90 * len(t) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(terms(text)) if x in t)
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_all_scores(spark, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "日本", "a1", "The"]
    chances = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, draw.choice([" ", ", ", "-"]).join(draw.choices(vocabulary, chances, k=draw.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(40)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 4, 20])))) for i in range(25)]
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asks = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 10)
    assert ordered(lexical_search.rank(given, asks, block_bytes=1500).collect()) == ordered(want)
    assert ordered(lexical_search.rank(given, asks, item_bytes=300).collect()) == ordered(want)


def test_bounds_spare_strata():
    visited = []

    class Counted(lexical_search.Strata):
        def _visit(self, pairs, *rest):
            visited.append(len(pairs))
            super()._visit(pairs, *rest)

    draw = random.Random(5)
    block = lexical_search._Block(2000, 2000 * 60)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(3000)], [1 / (i + 5) for i in range(3000)], k=draw.randint(5, 120))).encode() for _ in range(2000)]
    block.add(lexical_search.np.arange(2000), texts)
    asks = [" ".join(sorted(set(t.decode().split()), key=lambda w: -int(w[1:]))[:6]) for t in texts[:40]]
    items = lexical_search.Items(asks)
    strata = Counted(block.rows(), items.names())
    holding = strata.holding(len(items.terms))
    weights = lexical_search.np.array([lexical_search.weight(2000, int(n)) for n in holding])
    best = lexical_search.Best(items.count, 3)
    strata.search(items, weights, best)
    assert sum(visited) < 0.6 * items.count * strata.count, sum(visited)
    full = lexical_search.Best(items.count, 3)
    lexical_search.FIRST, kept = 10**6, lexical_search.FIRST
    try:
        strata.search(items, weights, full)
    finally:
        lexical_search.FIRST = kept
    assert [x.tolist() for x in (best.item, best.score, best.doc)] == [x.tolist() for x in (full.item, full.score, full.doc)]


def test_every_kind_of_row(spark):
    long = "rare " + "word " * 50_000
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha BETA"), (5, long), (6, "ÄB äb"), (7, "x_y{z}~a\x7fb")]
    items = [(1, "alpha"), (1, "beta"), (2, None), (3, ""), (None, "rare alpha"), (4, "nothing here"), (5, "äb"), (6, "Äb X B"), (7, "ÄB")]
    want = brute(docs, [(1, "alpha"), (None, "rare alpha"), (4, "nothing here"), (5, "äb"), (6, "Äb X B"), (7, "ÄB")], 10)
    given = spark.createDataFrame([(i, t, 1, "m") for i, t in docs], "doc_id long, text string, score int, m string")
    asks = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert ordered(lexical_search.rank(given, asks).collect()) == ordered(want)
    assert lexical_search.rank(given.limit(0), asks).collect() == [] and lexical_search.rank(given, asks.limit(0)).collect() == []
