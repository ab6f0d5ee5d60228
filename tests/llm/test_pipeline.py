import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from depgrove.llm import exact_dedup, mixing, packing
from depgrove.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_over_the_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns
        kept[name] = [r["doc_id"] for r in after.collect()]
        before = after
    source = {r["doc_id"]: r for r in docs.collect()}
    assert len(kept["language"]) == sum(bool(re.search(r"[^\W\d_]", r["text"] or "")) for r in source.values())
    largest = defaultdict(int)
    for i in kept["language"]:
        largest[source[i]["text"]] = max(largest[source[i]["text"]], i)
    assert sorted(kept["exact_dedup"]) == sorted(largest.values())
    assert set(kept["near_dedup"]) <= set(kept["exact_dedup"]) and len(set(kept["near_dedup"])) == len(kept["near_dedup"])
    assert max(Counter(kept["mix"]).values()) <= 2
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first()[0] == _tokens([source[i]["text"] for i in kept["mix"]])


def _tokens(texts):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sum(len(e.ids) + 1 for e in encoder.encode_batch(texts, add_special_tokens=False))


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "a", "7", "é", "a ", "-", "日"])
def test_long_runs_of_one_kind_are_tokenised(run):
    text = "x" + run * (1_000_000 // len(run)) + "y"
    paths = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)
    ids = packing.encoder(*paths)(text)
    assert ids == Tokenizer.from_file(paths[0]).encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    import zlib

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = [(1, "Hello, wörld!\n\n  it's 2024 "), (2, ""), (3, None), (4, "the word " * 5000), (5, "日本語 🙂 <|endoftext|> x"), (None, "null id"), (5, "日本語 🙂 <|endoftext|> x"), (6, "z" * 3000), *[(10 + i, "ab " * i) for i in range(300)]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    out = packing.pack(packing.pieces(docs)).collect()
    wanted = Counter()
    for doc_id, text in rows:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(packing.pieces(docs.limit(0))).collect() == []


def test_packed_sequences_obey_all_three_capacities(spark, sf_dir):
    out = packing.pack(packing.pieces(table(spark, sf_dir, "documents")), max_documents=3, max_cost=2_500_000.0, weights=(1.0, 0.5, 0.5)).collect()
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append(r["length"])
    assert all(sum(x) <= 2048 for x in held.values())
    several = [x for x in held.values() if len(x) > 1]
    assert several and all(len(x) <= 3 and sum(n * n for n in x) <= 2_500_000 for x in several)
    assert any(len(x) == 3 for x in several)


def test_best_fit_keeps_every_constraint():
    draw = np.random.default_rng(1)
    for rule in ("norm", "dot"):
        tokens = np.sort(draw.integers(1, 100, 500))[::-1].astype(float)
        demand = np.stack([tokens, np.ones(500), tokens**2], axis=1)
        capacity = np.array([100.0, 5.0, 6000.0])
        bins = packing.best_fit(demand, capacity, np.array([1.0, 0.5, 0.5]), rule)
        for k in range(3):
            used = np.bincount(bins, weights=demand[:, k])
            alone = np.bincount(bins) == 1
            assert (used[~alone] <= capacity[k] + 1e-6).all()


def test_mix_meets_targets_and_limits(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "a b c " * 50, None, None, 5), (9003, "", None, "empty", 0), (9003, "", None, "empty", 0)], docs.schema))
    first = sorted(map(tuple, mixing.mix(rows, block=40).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(rows.repartition(5), block=40).collect()), key=str)
    out = mixing.mix(rows, block=40).collect()
    sizes = {r["source"]: r["source_size"] for r in out}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, live = 1.5 * sum(sizes.values()), {}, set(order)
    while live:  # water filling, source by source
        level = (total - sum(target.values())) / sum(weight[s] for s in live)
        full = {s for s in live if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in live}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        live -= full
    taken = Counter()
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        largest = max(r["size"] for r in out if r["source"] == s)
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], largest / 2)
    repeated = mixing.mixed(rows, block=40)
    assert repeated.columns == docs.columns
    words = sum(len(WORDS.findall(r["text"] or "")) for r in repeated.collect())
    assert words == sum(r["taken"] for r in out)
    assert mixing.mix(rows.limit(0)).collect() == [] and mixing.mixed(rows.limit(0)).collect() == []


def test_exact_dedup_with_spills_and_edge_cases(spark):
    rows = [(i, f"text {i % 37} " * (i % 5 + 1), i) for i in range(400)] + [(None, "", 1), (None, None, 2), (7, "same", 3), (7, "same", 3), (3, "same", 4), (8, " same", 5), (9, "long " * 200_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(3)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for budget in (exact_dedup.BUDGET, 300):
        out = exact_dedup.classes(docs, budget).collect()
        assert len(out) == len(rows)
        kept = Counter()
        for r in out:
            texts = [t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
            ids = groups[texts[0]]
            assert r["doc_id"] in ids and r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
            if r["kept"]:
                kept[texts[0]] += 1
                assert r["doc_id"] == r["keep_id"]
        assert kept == Counter(dict.fromkeys(groups, 1))
        stay = exact_dedup.distinct_texts(docs, budget)
        assert stay.columns == docs.columns
        got = sorted((r["text"] or "", r["doc_id"]) for r in stay.collect() if r["text"])
        assert got == sorted((t, max(i for i in ids if i is not None)) for t, ids in groups.items() if t)
        assert stay.count() == len(groups)
    assert exact_dedup.classes(docs.limit(0)).collect() == [] and exact_dedup.distinct_texts(docs.limit(0)).collect() == []


def test_registered_packing_scores_all_three_residuals(spark, sf_dir, monkeypatch):
    import corpus_pipeline
    from depgrove.llm.queries import QUERIES

    asked = []
    monkeypatch.setattr(packing, "pack", lambda cut, **given: asked.append(given))
    QUERIES["op8_vector_best_fit"](spark, sf_dir)
    corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    for given in asked:
        assert given["max_documents"] == 2048 and given["max_cost"] == 2048**2 and min(given["weights"]) > 0
    assert len(asked) == 2
