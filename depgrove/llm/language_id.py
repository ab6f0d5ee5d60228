"""Language identification by cross-parsing against suffix automata.

A bounded sample of labelled text per language becomes a suffix automaton.  A text is
parsed greedily: each phrase is the longest match that the automaton can read, and the
language that needs the fewest phrases for the text's length wins.  Many stretches of
text are parsed at once, one step of all of them per array operation.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depgrove.llm.common import CHUNK_BYTES, give_back, kept

#: The documented bound of the labelled sample: characters of one language, documents
#: that are read for them, and the symbols told apart (the rest share one).
SAMPLE_CHARS = 40_000
SAMPLE_DOCS = 60
SYMBOLS = 63
#: Characters of one lane of the parser; a phrase ends where a lane ends.
LANE = 256
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


class Automaton:
    """Suffix automaton of a sequence of symbols: ``table[state, symbol]`` is the next state or -1."""

    def __init__(self, text: np.ndarray, symbols: int):
        most = 2 * len(text) + 2
        table = np.full((most, symbols), -1, dtype=np.int32)
        link = [-1] * most
        length = [0] * most
        last, size = 0, 1
        for c in text.tolist():
            now, size = size, size + 1
            length[now] = length[last] + 1
            p = last
            while p >= 0 and table[p, c] < 0:
                table[p, c] = now
                p = link[p]
            if p < 0:
                link[now] = 0
            else:
                q = int(table[p, c])
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin, size = size, size + 1
                    length[twin], link[twin] = length[p] + 1, link[q]
                    table[twin] = table[q]
                    while p >= 0 and table[p, c] == q:
                        table[p, c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        self.table = np.ascontiguousarray(table[:size])

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of every column of ``lanes`` (steps by lanes; -1 after the end)."""
        flat = self.table.ravel()
        symbols = self.table.shape[1]
        start = self.table[0]
        state = np.zeros(lanes.shape[1], dtype=np.int32)
        count = np.zeros(lanes.shape[1], dtype=np.int32)
        for symbol in lanes:
            live = symbol >= 0
            symbol = np.where(live, symbol, 0)
            follow = flat[state * symbols + symbol]
            ends = (follow < 0) & live
            count += ends
            # a new phrase starts with this symbol; one that the sample lacks is a phrase by itself
            state = np.where(ends, np.maximum(start[symbol], 0), np.where(live, follow, state))
        return count + (lanes[0] >= 0 if len(lanes) else 0)


class Model:
    """Automata per language over a common set of symbols."""

    def __init__(self, samples: dict[str, str], symbols: int = SYMBOLS):
        self.languages = sorted(samples)
        counted = Counter()
        for text in samples.values():
            counted.update(text.lower())
        self.symbol = np.zeros(0x110000, dtype=np.int8)  # 0: all others
        for i, (c, _) in enumerate(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:symbols]):
            self.symbol[ord(c)] = i + 1
        self.automata = [Automaton(self.symbols(samples[x]), symbols + 1) for x in self.languages]

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def phrases(self, texts: list[str], lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the number of symbols of each text."""
        coded = [self.symbols(t) for t in texts]
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        lanes_of = -(-lengths // lane)
        owner = np.repeat(np.arange(len(texts)), lanes_of)
        grid = np.full((int(lanes_of.sum()), lane), -1, dtype=np.int8)
        at = np.cumsum(lanes_of) - lanes_of
        flat = grid.ravel()
        for c, begin in zip(coded, at, strict=True):
            flat[begin * lane : begin * lane + len(c)] = c
        steps = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for k, automaton in enumerate(self.automata):
            np.add.at(out[:, k], owner, automaton.phrases(steps))
        return out, lengths


def _model(key: str, samples: Broadcast) -> Model:
    """The broadcast samples' automata, built once in a worker; ``key`` is their digest."""
    return kept(f"language {key}", lambda: Model(samples.value))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, chars: int = SAMPLE_CHARS, docs: int = SAMPLE_DOCS) -> dict[str, str]:
    """Sample text of every language of ``doc_id, text, lang``: at most ``chars`` characters each.

    The documents come in the order of a hash of their id, at most ``docs`` of one
    language, and a long one gives its first ``chars // 4`` characters, so that several
    authors are heard.  Null texts and languages teach nothing.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.length("text"))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    part = rows.select("lang", "doc_id", F.substring("text", 1, chars // 4).alias("text"))
    chosen = part.withColumn("at", F.row_number().over(order)).where(F.col("at") <= docs).select("lang", "at", "text")
    samples: dict[str, str] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["at"])):
        have = samples.get(row["lang"], "")
        if len(have) < chars:
            samples[row["lang"]] = (have + "\n" + row["text"])[:chars].lstrip("\n")
    return samples


RESULT = "lang_pred string, score double"


def identify(docs: DataFrame, samples: dict[str, str], returned: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` instead of any columns of these names.

    The prediction reads the whole text and nothing else.  A text that is null or has
    no letter, and every text when nothing was learned, is ``und`` with score 0.  The
    score is the share of phrases that the best language saves against the second; 1
    where only one language is known.  Ties go to the first language by code point.
    ``returned`` names the columns that come back, all by default.  Repeated rows are
    repeated results; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    back = [c for c in names if returned is None or c in returned]
    given = docs.sparkSession.sparkContext.broadcast(samples)
    key = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    # a text goes to the worker once
    row = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" and c not in back else F.col(f"`{c}`") for c in names])
    same = isinstance(docs.schema["text"].dataType, T.StringType) or "text" not in back
    packed = docs.select(row.alias("row"), *([] if same else [F.col("text").cast("string").alias("said")]))
    at = [names.index(c) for c in back]
    of = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            predicted: list[str] = []
            scores: list[float] = []
            texts: list[str] = []
            held = 0

            def settle():
                nonlocal texts, held
                better, score = _decide(_model(key, given) if given.value else None, texts)
                predicted.extend(better)
                scores.extend(score)
                texts, held = [], 0

            rows = batch.column("row")
            for value in rows.field(of) if same else batch.column("said"):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    settle()
            settle()
            told = pa.StructArray.from_arrays([rows.field(i) for i in at], fields=[rows.type.field(i) for i in at])
            yield pa.RecordBatch.from_arrays([told, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])
            del rows, told, batch
            give_back()

    kind = T.StructType([docs.schema[c] for c in back]).simpleString()
    out = packed.mapInArrow(run, f"row {kind}, {RESULT}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in back], "lang_pred", "score")


def _decide(model: Model | None, texts: list[str]) -> tuple[list[str], list[float]]:
    said = [i for i, t in enumerate(texts) if _LETTER.search(t)] if model else []
    predicted, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if said:
        phrases, _ = model.phrases([texts[i] for i in said])
        order = np.argsort(phrases, axis=1, kind="stable")
        for row, i in enumerate(said):
            best = phrases[row, order[row, 0]]
            second = phrases[row, order[row, 1]] if phrases.shape[1] > 1 else 0
            predicted[i] = model.languages[order[row, 0]]
            scores[i] = 1.0 if phrases.shape[1] == 1 else float(1 - best / second) if second else 0.0
    return predicted, scores


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from the documents that are not held out, predict all."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    samples = learn(ids.where(~held_out(F.col("doc_id"))))
    named = ids.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(named, samples, ["doc_id", "held_out"])


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose language can be told; those predicted ``und`` go."""
    samples = learn(docs.where(~held_out(F.col("doc_id").cast("long"))))
    # columns may have any names, those of the results included
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)])
    told = identify(plain, samples).where(F.col("lang_pred") != UNDETERMINED)
    return told.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
