import random
import time

import numpy as np

from depgrove.llm import pseudo_likelihood as pl
from depgrove.llm.common import Words, table


def test_neighbourhoods_stay_in_their_text():
    near = pl.neighbourhoods(np.array([1, 2, 3, 9], dtype=np.uint8), np.array([0, 3, 3, 4]))
    e = pl.EDGE
    assert near.tolist() == [[1, e, e, 2, 3], [2, e, 1, 3, e], [3, 1, 2, e, e], [9, e, e, e, e]]


def test_gradient_lowers_the_loss_and_probabilities_sum_to_one():
    draw = np.random.default_rng(0)
    near = np.stack([draw.integers(0, 4, 4000)] * 5, axis=1).astype(np.uint8)
    network = pl.Network.fresh(1)
    before = network.log_probability(near).mean()
    network.train(near, draw)
    assert network.log_probability(near).mean() > before + 2
    rows = np.repeat(near[:1], pl.CLASSES, axis=0)
    rows[:, 0] = np.arange(pl.CLASSES)
    assert abs(np.exp(network.log_probability(rows)).sum() - 1) < 1e-3


def test_scores_agree_with_a_direct_sum_and_prefer_real_order(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    words, network = pl.fit(docs)
    out = {r["doc_id"]: r for r in pl.score(docs, words, network).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 40").collect()}
    place, bias, output, shift = network.parts
    for i, text in texts.items():
        classes = words.encode(Words([text.encode()]).hash)
        total = 0.0
        for t, c in enumerate(classes):
            hidden = bias.astype(float).copy()
            for k, step in enumerate(pl.PLACES):
                hidden += place[k][classes[t + step] if 0 <= t + step < len(classes) else pl.EDGE]
            logits = np.tanh(hidden) @ output + shift
            total += logits[c] - np.log(np.exp(logits).sum()) - words.log_size[c]
        assert out[i]["n_tokens"] == len(text.split())
        assert abs(out[i]["log_likelihood"] - total) < 1e-3 * max(1, abs(total))
    # words of another language or drawn at random fit worse than the corpus
    draw = random.Random(4)
    odd = spark.createDataFrame([(i, " ".join(f"x{draw.randrange(10**6)}" for _ in range(200)), 1.0) for i in range(20)], "doc_id long, text string, per_token double")
    strange = [r["per_token"] for r in pl.score(odd, words, network).collect()]
    usual = sorted(r["per_token"] for r in out.values())
    assert max(strange) < usual[len(usual) // 10]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 1), (3, "a " * 100_000, 1), (3, "a b", 1)], "doc_id long, text string, n_tokens int")
    words, network = pl.fit(docs)
    out = sorted(map(tuple, pl.score(docs, words, network).select("doc_id", "n_tokens", "log_likelihood", "per_token").collect()), key=str)
    assert [r[1] for r in out] == [0, 0, 100_000, 2, 2]
    assert out[0][2:] == (0.0, None)
    empty = docs.limit(0)
    assert pl.score(empty, *pl.fit(empty)).collect() == []


def test_every_position_trains(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7)) for i in range(50)], "doc_id long, text string")
    words = pl.vocabulary(pl.word_counts(docs))
    blocks = pl.sequences(docs, words).select("classes", "first").toArrow()
    assert sum(map(len, pl.expanded(iter(blocks.to_batches()), words.edge))) == sum(3 * (i % 7) for i in range(50))


def test_words_of_a_class_share_it_by_count(spark):
    text = " ".join(["often"] * 60 + ["seldom"] * 20)
    docs = spark.createDataFrame([(0, text), (1, "often"), (2, "seldom"), (3, "never")], "doc_id long, text string")
    counts = pl.word_counts(docs)
    words, network = pl.fit(docs, counts=counts, frequent=0, hashed=1)
    for shared in (1 << 17, 1, 0):  # broadcast, both ways, joined
        got = {r["doc_id"]: r["log_likelihood"] for r in pl.score(docs, words, network, counts, shared).collect()}
        assert abs(got[1] - got[2] - np.log(61 / 21)) < 1e-6
        assert abs(got[2] - got[3] - np.log(21 / 1)) < 1e-6
    frequent, hashed = pl.WIDE
    assert frequent + hashed + 1 > 256
    assert words.encode(np.arange(9, dtype=np.uint64)).dtype == np.uint16


def test_blocks_and_large_logits_give_the_same_network(monkeypatch):
    draw = np.random.default_rng(3)
    near = draw.integers(0, 40, (3000, 5)).astype(np.uint16)

    def trained(block, most):
        monkeypatch.setattr(pl, "BLOCK", block)
        monkeypatch.setattr(pl, "MOST_LOGIT", most)
        network = pl.Network.fresh(2)
        network.train(near, np.random.default_rng(4))
        return network.flat, network.log_probability(near)

    flat, logs = trained(1024, 60)
    for block, most in ((100, 60), (1024, 0)):
        other, more = trained(block, most)
        assert np.abs(flat - other).max() < 1e-3 and np.abs(logs - more).max() < 1e-3
    network = pl.Network.fresh(2)
    network.parts[3][:2] = 500, 400  # the exponential of either is beyond a float
    assert np.isfinite(network.log_probability(near)).all()


def direct(network, row):
    place, bias, head, tail = (p.astype(float) for p in network.parts)
    hidden = np.append(np.tanh(bias + sum(place[k][c] for k, c in enumerate(row[1:]))), 1)
    group, own = divmod(int(row[0]), tail.shape[2])
    kept = min(tail.shape[2], network.classes - group * tail.shape[2])
    a, b = hidden @ head, (hidden @ tail[group])[:kept]
    return a[group] - np.log(np.exp(a).sum()) + b[own] - np.log(np.exp(b).sum())


def test_grouped_probabilities_agree_with_a_direct_sum(monkeypatch):
    draw = np.random.default_rng(7)
    for classes in (2, 37, 256, 512):
        network = pl.Grouped.fresh(3, classes)
        network.flat *= 4
        near = draw.integers(0, classes, (2500, 5)).astype(np.uint16)
        for block, most in ((1024, 60), (100, 0)):
            monkeypatch.setattr(pl, "BLOCK", block)
            monkeypatch.setattr(pl, "MOST_LOGIT", most)
            got = network.log_probability(near)
            assert max(abs(got[i] - direct(network, near[i])) for i in range(0, 2500, 83)) < 1e-4
        rows = np.repeat(near[:1], classes, axis=0)
        rows[:, 0] = np.arange(classes)
        assert abs(np.exp(network.log_probability(rows)).sum() - 1) < 1e-4
    network.parts[2][-1, :2] = 500, 400  # the exponential of either is beyond a float
    assert np.isfinite(network.log_probability(near)).all()


def test_grouped_step_follows_the_gradient():
    near = np.random.default_rng(8).integers(0, 37, (300, 5)).astype(np.uint16)
    network = pl.Grouped.fresh(4, 37)
    before = network.flat.copy()
    squares = [np.full_like(p, 1e12) for p in network.parts]  # a step is a millionth of the gradient
    network.train(near, np.random.default_rng(0), rate=1e6, squares=squares)
    step = before - network.flat
    for i in [int(np.abs(step).argmax()), *np.random.default_rng(9).integers(0, len(before), 60)]:
        moved = []
        for by in (1e-2, -1e-2):
            flat = before.copy()
            flat[i] += by
            moved.append(pl.Grouped(flat, 37).log_probability(near).mean())
        assert abs(step[i] - (moved[1] - moved[0]) / 2e-2) < 1e-4, i


def test_grouped_learns_as_well_as_all_classes_at_once_in_less_time():
    draw = np.random.default_rng(10)
    chain = (np.cumsum(draw.geometric(0.1, 200_000)) % 300).astype(np.uint16)
    near = pl.neighbourhoods(chain, np.array([0, len(chain)]), 511)
    took, fits = {}, {}
    for kind in (pl.Network, pl.Grouped):
        network = kind.fresh(5, 512)
        since = time.process_time()
        network.train(near[:150_000], np.random.default_rng(1))
        took[kind] = time.process_time() - since
        fits[kind] = network.log_probability(near[150_000:]).mean()
    assert fits[pl.Grouped] > fits[pl.Network] - 0.05
    assert took[pl.Grouped] < 0.75 * took[pl.Network]


def test_grouped_scores_equal_rows_alike(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").unionByName(table(spark, "/root/testdata/sf0.001", "documents"))
    counts = pl.word_counts(docs)
    words, network = pl.fit(docs, counts=counts, frequent=255, hashed=256, kind=pl.Grouped)
    assert isinstance(network, pl.Grouped)
    out = pl.score(docs, words, network, counts).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == docs.count() and len({(r["doc_id"], r["log_likelihood"]) for r in out}) == len(texts)
    assert all(r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) for r in out)
