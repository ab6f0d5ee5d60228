import hashlib
import random
import re

import numpy as np
import pytest

from depgrove.llm import substring_dedup
from depgrove.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, spans int, kept string"


def brute(rows, window=50):
    first = {}
    split = [WORDS.findall(r[1] or "") for r in rows]
    rank = [float("inf") if r[0] is None else r[0] for r in rows]
    for r, words in zip(rank, split):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, r), r)
    out = []
    for row, r, words in zip(rows, rank, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < r:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((row[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = substring_dedup.without_repeats(docs, **parameters).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_a_dictionary_of_windows(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["É", "the", "the,"]
    passages = [draw.choices(words, k=draw.choice([49, 50, 51, 60, 90, 300])) for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(draw.choice([0, 1, 2, 3])):
            text += draw.choices(words, k=draw.choice([0, 3, 20, 70]))
            p = draw.choice(passages)
            cut = draw.randrange(len(p))
            text += draw.choice([p, p[cut:], p[:cut]])
        rows.append((i, draw.choice([" ", "\n", " \t"]).join(text), 1, "x"))
    rows += [(200, None, 1, "x"), (201, "", 1, "x"), (202, " \n", None, None), (203, "the " * 400, 1, "x"), (204, "the " * 130, 1, "x")]
    rows += [(None, " ".join(passages[3]), 1, "x"), (5, " ".join(passages[4]), 1, "x"), (5, " ".join(passages[4]), 1, "x"), (3, " ".join(passages[5] * 3), 1, "x")]
    rows += [(300, " ".join(map(str, range(30_000))), 1, "x"), (301, " ".join(map(str, range(20_000, 25_000))), 1, "x")]
    assert run(spark, rows) == brute(rows)


def test_agrees_on_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], 1, "x") for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_kept_text(spark):
    assert run(spark, []) == []
    text = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 1, "x"), (2, f"new  {text}\nend", 1, "x")], SCHEMA)
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs).collect()}
    assert out[1]["kept"].decode() == text
    assert out[2]["kept"] == b"new end"
    assert [tuple(s) for s in out[2]["spans"]] == [(1, 61)]


def test_least_in_run_by_definition():
    draw = np.random.default_rng(3)
    for n in (0, 1, 30, 31, 60, 200):
        h = draw.integers(0, 50, n, dtype=np.uint64)
        want = np.zeros(n, bool)
        for p in range(n):
            for first in range(p - 30, p + 1, 10):
                if first >= 0 and first + 30 < n:
                    want[p] |= h[p] == min(h[first : first + 31 : 10])
        assert (substring_dedup.least_in_run(h, 10, 4) == want).all()
