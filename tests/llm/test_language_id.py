import random

import pytest

from depgrove.llm import language_id
from depgrove.llm.common import table


def greedy(sample, text):
    """Phrases of a greedy parse by substring search; an unknown symbol is a phrase by itself."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        if text[at:end] not in sample:
            end = at + 1
        count, at = count + 1, end
    return count


@pytest.mark.parametrize("seed", range(4))
def test_phrases_agree_with_substring_search(seed):
    draw = random.Random(seed)
    samples = {k: "".join(draw.choices("abcd", k=200)) for k in ("x", "y")}
    model = language_id.Model(samples)
    texts = ["".join(draw.choices("abcd", k=n)) for n in (0, 1, 2, 17, 255, 256)]
    phrases, lengths = model.phrases(texts)
    assert lengths.tolist() == [len(t) for t in texts]
    for row, text in zip(phrases, texts):
        assert row.tolist() == [greedy(samples[k], text) for k in ("x", "y")]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in out) / len(out)
    assert len(out) > 150 and right > 0.95


def test_edge_cases(spark):
    rows = [(i, t, lang, "n") for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("the dog", "en"), ("die Maus", "de"), (None, "en"), ("", "de"), ("123 - ?", None), ("the " * 50_000, None)] * 3)]
    rows.append((None, "die Katze", None, "n"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language_id.predict(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r["doc_id"]][1] if r["doc_id"] is not None else "die Katze"
        assert (r["lang_pred"] == "und") == (not text or "cat" not in text and not any(c.isalpha() for c in text))
        assert 0 <= r["score"] <= 1
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 16
    empty = docs.limit(0)
    assert language_id.predict(empty).collect() == []
    assert language_id.accepted(empty).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.predict(docs).first()["lang_pred"] == "und"


def test_reruns_agree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = sorted(map(tuple, language_id.predict(docs).collect()))
    assert first == sorted(map(tuple, language_id.predict(docs.repartition(7)).collect()))
