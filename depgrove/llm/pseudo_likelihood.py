"""Document scores by masked pseudo-likelihood.

A small network predicts every token from the words on both sides of it: hidden =
tanh(bias + sum of a vector for each place and neighbour), logits = hidden @ output.
``Grouped`` makes the probability of a class from its group's and its own in the group.
Tokens are words; the most frequent ones of the corpus are classes of their own, the
others share hashed classes and divide a class's probability by their counts (evenly
where no counts are given).  A document's score is the sum of the conditional
log-probabilities of all its tokens.

Every position of every document serves in training.  Partitions train on their own
positions from common parameters, and the parameters are averaged by number of
positions, round by round; they have a fixed size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgrove.llm.common import Words, checkpointed, mix, signed, text_blocks

#: Classes: frequent words, hashed classes for the others, and the place beyond a text's ends.
FREQUENT, HASHED = 127, 128
CLASSES = FREQUENT + HASHED + 1
EDGE = CLASSES - 1
REACH = 2
HIDDEN = 32
#: The same for the registered query.
WIDE = (255, 256)
#: Words whose counts are broadcast for scoring; the rarer ones are joined.
SHARED = 1 << 17
#: Positions that one training task expands at a time.
HELD = 1 << 20
ROUNDS = 2
BATCH = 1024
#: Rows whose probabilities are held at a time, and the logit up to which no maximum is taken off before the exponential.
BLOCK = 1024
MOST_LOGIT = 60
PLACES = [k for k in range(-REACH, REACH + 1) if k]


@dataclass
class Vocabulary:
    """Hashes of the frequent words, ascending, their classes, and the logs of the words and of the tokens in each class."""

    hashes: np.ndarray
    classes: np.ndarray
    log_size: np.ndarray
    log_total: np.ndarray
    frequent: int = FREQUENT
    hashed: int = HASHED

    @property
    def edge(self) -> int:
        return self.frequent + self.hashed

    def encode(self, words: np.ndarray) -> np.ndarray:
        out = (self.frequent + (mix(words ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.hashed)).astype(np.int64)).astype(np.uint16)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = self.hashes[at] == words
            out[known] = self.classes[at[known]]
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: hashes of the words of all documents with their counts."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], schema=schema)

        for _, texts in text_blocks(batches):
            held.append(Words(texts).hash)
            size += len(held[-1])
            if size > 4_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return checkpointed(_texts(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, hashed: int = HASHED) -> Vocabulary:
    """Classes of counted words; the driver receives the frequent ones and two numbers for each class."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(frequent).collect()
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    classes = frequent + hashed + 1
    out = Vocabulary(hashes[order], np.arange(len(hashes), dtype=np.uint16)[order], np.zeros(classes), np.zeros(classes), frequent, hashed)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
        for batch in batches:
            own = out.encode(batch.column("word").to_numpy().view(np.uint64))
            size += np.bincount(own, minlength=classes)
            np.add.at(total, own, batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(size), pa.array(total)], names=["class", "words", "tokens"])

    found = counts.select("word", "n").mapInArrow(sizes, "class long, words long, tokens long").groupBy("class").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    for row in found.collect():
        out.log_size[row["class"]] = math.log(max(row["words"], 1))
        out.log_total[row["class"]] = math.log(max(row["tokens"], 1))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").cast("binary").alias("text"))


def neighbourhoods(classes: np.ndarray, first: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """Token classes with their neighbours, tokens by 1 + 2 * REACH: the token itself comes first.

    ``first`` marks where texts start in ``classes``; beyond a text lies ``edge``.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(classes)) + REACH + owner * REACH
    wide = np.full(len(classes) + REACH * (len(counts) + 1), edge, dtype=np.uint16)
    wide[at] = classes
    return np.stack([classes] + [wide[at + k] for k in PLACES], axis=1)


class Network:
    """Parameters: a vector by place and class, hidden bias, output matrix and its bias."""

    @staticmethod
    def shapes(classes: int) -> tuple[tuple[int, ...], ...]:
        return ((len(PLACES), classes, HIDDEN), (HIDDEN,), (HIDDEN, classes), (classes,))

    def __init__(self, flat: np.ndarray, classes: int = CLASSES):
        self.flat, self.classes, self.parts, at = flat, classes, [], 0
        for shape in self.shapes(classes):
            n = math.prod(shape)
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, seed: int, classes: int = CLASSES) -> Network:
        draw = np.random.default_rng(seed)
        flat = draw.normal(0, 0.1, sum(map(math.prod, cls.shapes(classes)))).astype(np.float32)
        out = cls(flat, classes)
        for bias in out.biases():
            bias[:] = 0
        return out

    def biases(self) -> tuple[np.ndarray, ...]:
        return self.parts[1], self.parts[3]

    def _hidden(self, near: np.ndarray) -> np.ndarray:
        place, bias, _, _ = self.parts
        total = bias + place[0].take(near[:, 1], axis=0)
        for k in range(1, len(PLACES)):
            total += place[k].take(near[:, k + 1], axis=0)
        return np.tanh(total)

    def _exponentials(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values with a 1 behind each row, and what is proportional to the probabilities."""
        _, _, output, shift = self.parts
        wide = np.ones((len(hidden), HIDDEN + 1), dtype=np.float32)
        wide[:, :HIDDEN] = hidden
        out = wide @ np.concatenate((output, shift[None]))
        # hidden values lie between -1 and 1, so no logit is beyond this
        if np.abs(output).sum(axis=0).max() + np.abs(shift).max() > MOST_LOGIT:
            out -= out.max(axis=1, keepdims=True)
        return wide, np.exp(out, out=out)

    def log_probability(self, near: np.ndarray) -> np.ndarray:
        """Of each row's first class given the others."""
        out = np.empty(len(near), dtype=np.float64)
        _, _, output, shift = self.parts
        across, ones = np.ascontiguousarray(output.T), np.ones(self.classes, dtype=np.float32)
        shifted = np.abs(output).sum(axis=0).max() + np.abs(shift).max() > MOST_LOGIT
        for a in range(0, len(near), BLOCK):
            rows = near[a : a + BLOCK]
            hidden = self._hidden(rows)
            if shifted:
                logits = hidden @ output + shift
                top = logits.max(axis=1)
                out[a : a + BLOCK] = logits[np.arange(len(rows)), rows[:, 0]] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
            else:
                own = np.einsum("ij,ij->i", hidden, across[rows[:, 0]]) + shift[rows[:, 0]]
                out[a : a + BLOCK] = own - np.log(self._exponentials(hidden)[1] @ ones)
        return out

    def steps(self) -> list[np.ndarray]:
        """Sums of squared gradients, as they are before training."""
        return [np.full(p.shape, 1e-3, dtype=np.float32) for p in self.parts]

    def train(self, near: np.ndarray, draw: np.random.Generator, rate: float = 0.05, squares: list[np.ndarray] | None = None) -> None:
        """One pass of minibatch descent with per-parameter rates over the rows, shuffled; ``squares`` goes on from call to call."""
        place, bias, output, shift = self.parts
        squares = self.steps() if squares is None else squares
        order = draw.permutation(len(near))
        ones, flat_place, flat_square = np.ones(self.classes, dtype=np.float32), place.reshape(-1, HIDDEN), squares[0].reshape(-1, HIDDEN)
        behind = (np.arange(len(PLACES)) * self.classes).astype(np.min_scalar_type(len(PLACES) * self.classes))
        for a in range(0, len(near), BATCH):
            rows = near[order[a : a + BATCH]]
            back = np.empty((len(rows), HIDDEN), dtype=np.float32)
            total_g = np.zeros((HIDDEN + 1, self.classes), dtype=np.float32)
            for b in range(0, len(rows), BLOCK):  # a block's probabilities stay in the processor's cache
                part = rows[b : b + BLOCK]
                hidden = self._hidden(part)
                wide, logits = self._exponentials(hidden)
                total = logits @ ones
                logits[np.arange(len(part)), part[:, 0]] -= total
                share = (1 / (total * np.float32(len(rows))))[:, None]
                back[b : b + BLOCK] = (logits @ output.T) * share * (1 - hidden * hidden)
                wide *= share
                total_g += wide.T @ logits
            # only the vectors of classes that occur have a gradient
            keys = (rows[:, 1:] + behind).ravel()
            by_key = np.argsort(keys, kind="stable")
            keys = keys[by_key]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sums, at = np.add.reduceat(back[by_key // len(PLACES)], first, axis=0), keys[first]
            square = flat_square[at] + sums * sums
            flat_square[at] = square
            flat_place[at] -= rate * sums / np.sqrt(square)
            for part, square, g in zip(self.parts[1:], squares[1:], (back.sum(axis=0), total_g[:HIDDEN], total_g[HIDDEN]), strict=True):
                square += g * g
                part -= rate * g / np.sqrt(square)


class Grouped(Network):
    """Probabilities by two steps: of a class's group, and of the class in its group; they add up to 1 over all classes.

    Parameters: a vector by place and class, hidden bias, output matrix of the groups and
    one of each group's classes, both with their biases as last rows.  A group holds
    about the root of the classes, a row's work grows with the groups and one group.
    """

    @staticmethod
    def shapes(classes: int) -> tuple[tuple[int, ...], ...]:
        inside = 1 << ((classes - 1).bit_length() + 1) // 2
        groups = -(-classes // inside)
        return ((len(PLACES), classes, HIDDEN), (HIDDEN,), (HIDDEN + 1, groups), (groups, HIDDEN + 1, inside))

    def biases(self) -> tuple[np.ndarray, ...]:
        return self.parts[1], self.parts[2][HIDDEN], self.parts[3][:, HIDDEN]

    def _wide(self, near: np.ndarray) -> np.ndarray:
        """Hidden values with a 1 behind each row."""
        out = np.ones((len(near), HIDDEN + 1), dtype=np.float32)
        out[:, :HIDDEN] = self._hidden(near)
        return out

    def _shifted(self) -> bool:
        """Whether a logit may be beyond MOST_LOGIT."""
        _, _, head, tail = self.parts
        return max(np.abs(head).sum(axis=0).max(), np.abs(tail).sum(axis=1).max()) > MOST_LOGIT

    def _inside(self, wide: np.ndarray, cuts: list[int]) -> np.ndarray:
        """Logits in the groups, of rows cut by group; the last group's places without a class have none."""
        tail = self.parts[3]
        out = np.empty((len(wide), tail.shape[2]), dtype=np.float32)
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                np.matmul(wide[a:b], tail[g], out=out[a:b])
        spare = tail.shape[0] * tail.shape[2] - self.classes
        if spare:
            out[cuts[-2] :, -spare:] = -np.inf
        return out

    def log_probability(self, near: np.ndarray) -> np.ndarray:
        _, _, head, tail = self.parts
        groups, inside = tail.shape[0], tail.shape[2]
        by = np.argsort(near[:, 0], kind="stable")
        near = near[by]
        group, own = (x.astype(np.intp) for x in np.divmod(near[:, 0], inside))
        bounds = np.searchsorted(group, np.arange(groups + 1))
        shifted = self._shifted()
        each = np.zeros(len(near), dtype=np.float64)
        for a in range(0, len(near), BLOCK):
            b = min(a + BLOCK, len(near))
            wide, at = self._wide(near[a:b]), np.arange(b - a)
            cuts = (np.clip(bounds, a, b) - a).tolist()
            for logits, chosen in ((wide @ head, group[a:b]), (self._inside(wide, cuts), own[a:b])):
                found = logits[at, chosen]
                exponentials, top = _exponentials(logits, shifted)
                each[a:b] += found - top - np.log(exponentials @ np.ones(exponentials.shape[1], dtype=np.float32))
        out = np.empty(len(near), dtype=np.float64)
        out[by] = each
        return out

    def train(self, near: np.ndarray, draw: np.random.Generator, rate: float = 0.05, squares: list[np.ndarray] | None = None) -> None:
        place, bias, head, tail = self.parts
        groups, inside = tail.shape[0], tail.shape[2]
        squares = self.steps() if squares is None else squares
        # batches as drawn, the rows of each by group
        order = draw.permutation(len(near))
        batches = -(-len(near) // BATCH)
        key = (np.arange(len(near)) // BATCH * groups + near[order, 0] // inside).astype(np.min_scalar_type(batches * groups))
        by = np.argsort(key, kind="stable")
        near = near[order[by]]
        bounds = np.searchsorted(key[by], np.arange(batches * groups + 1))
        group, own = (x.astype(np.intp) for x in np.divmod(near[:, 0], inside))
        tail_g, where = np.empty_like(tail), np.arange(place[0].size).reshape(place[0].shape)
        for turn, a in enumerate(range(0, len(near), BATCH)):
            rows = near[a : a + BATCH]
            wide, at, shifted = self._wide(rows), np.arange(len(rows)), self._shifted()
            cuts = (bounds[turn * groups : (turn + 1) * groups + 1] - a).tolist()

            def miss(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
                """Probabilities less what is true, divided by the rows."""
                out, _ = _exponentials(logits, shifted)
                out /= (out @ np.ones(out.shape[1], dtype=np.float32))[:, None]
                out[at, chosen] -= 1
                out *= np.float32(1 / len(rows))
                return out

            by_group = miss(wide @ head, group[a : a + BATCH])
            by_class = miss(self._inside(wide, cuts), own[a : a + BATCH])
            back = np.empty((len(rows), HIDDEN), dtype=np.float32)
            across = np.ascontiguousarray(tail[:, :HIDDEN].transpose(0, 2, 1))
            for g, (b, c) in enumerate(zip(cuts, cuts[1:])):
                np.matmul(wide[b:c].T, by_class[b:c], out=tail_g[g])
                np.matmul(by_class[b:c], across[g], out=back[b:c])
            back += by_group @ head[:HIDDEN].T
            hidden = wide[:, :HIDDEN]
            back *= 1 - hidden * hidden
            weights = back.ravel().astype(np.float64)
            gradients = [(bias, squares[1], back.sum(axis=0)), (head, squares[2], wide.T @ by_group), (tail, squares[3], tail_g)]
            for k in range(len(PLACES)):
                keys = where.take(rows[:, k + 1], axis=0)
                gradients.append((place[k], squares[0][k], np.bincount(keys.ravel(), weights, where.size).astype(np.float32).reshape(where.shape)))
            for part, square, g in gradients:
                square += g * g
                g *= np.float32(rate)
                g /= np.sqrt(square)
                part -= g


def _exponentials(logits: np.ndarray, shifted: bool) -> tuple[np.ndarray, np.ndarray | int]:
    """What is proportional to the probabilities, in place of the logits, and the greatest logit of each row where it was taken off."""
    top = 0
    if shifted:
        top = logits.max(axis=1)
        logits -= top[:, None]
    return np.exp(logits, out=logits), top


def sequences(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Classes of all tokens of all documents, ``block, classes binary, first binary``: runs of whole texts, dealt by content."""
    given = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("block", pa.int64()), ("classes", pa.binary()), ("first", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches):
            seen = Words(texts)
            if len(seen.hash):
                classes, first = given.value.encode(seen.hash).tobytes(), seen.first.astype(np.int64).tobytes()
                key = int.from_bytes(hashlib.blake2b(classes + first, digest_size=7).digest(), "little")
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([classes]), pa.array([first])], schema=schema)

    return checkpointed(_texts(docs).mapInArrow(run, "block long, classes binary, first binary").repartition("block"))


def expanded(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[np.ndarray]:
    """Neighbourhoods of every position of the blocks, about HELD rows at a time; a block is never divided."""
    held: list[np.ndarray] = []
    for batch in batches:
        for classes, first in zip(batch.column("classes"), batch.column("first"), strict=True):
            held.append(neighbourhoods(np.frombuffer(classes.as_py(), dtype=np.uint16), np.frombuffer(first.as_py(), dtype=np.int64), edge))
            if sum(map(len, held)) >= HELD:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def average(models: DataFrame) -> tuple[np.ndarray, int] | None:
    """Mean of ``flat`` weighted by ``n``; groups first, so no task receives more than about their root."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["n"].sum())
        flat = sum(np.frombuffer(f, dtype=np.float32).astype(np.float64) * n for f, n in zip(rows["flat"], rows["n"], strict=True)) / max(total, 1)
        return pd.DataFrame({"part": [0], "n": [total], "flat": [flat.astype(np.float32).tobytes()]})

    groups = max(1, math.isqrt(models.count()))
    some = models.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInPandas(mean, "part long, n long, flat binary")
    row = some.withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInPandas(mean, "part long, n long, flat binary").first()
    return (np.frombuffer(row["flat"], dtype=np.float32).copy(), row["n"]) if row else None


def fit(docs: DataFrame, rounds: int = ROUNDS, seed: int = 5, counts: DataFrame | None = None, frequent: int = FREQUENT, hashed: int = HASHED, kind: type[Network] = Network) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of a corpus, from all positions; texts without words teach nothing."""
    context = docs.sparkSession.sparkContext
    words = vocabulary(word_counts(docs) if counts is None else counts, frequent, hashed)
    blocks = sequences(docs, words)
    edge, classes = words.edge, words.edge + 1
    network = kind.fresh(seed, classes)
    for turn in range(rounds):
        common = context.broadcast(network.flat)

        def run(batches: Iterator[pa.RecordBatch], common=common, turn=turn) -> Iterator[pa.RecordBatch]:
            own, seen = kind(common.value.copy(), classes), 0
            squares = own.steps()
            for near in expanded(batches, edge):
                own.train(near, np.random.default_rng([seed, turn, zlib.crc32(near.tobytes())]), squares=squares)
                seen += len(near)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([own.flat.tobytes()], pa.binary())], names=["part", "n", "flat"])

        mean = average(checkpointed(blocks.sortWithinPartitions("block").select("classes", "first").mapInArrow(run, "part long, n long, flat binary")))
        if mean is None:
            break
        network = kind(mean[0], classes)
    return words, network


def score(docs: DataFrame, words: Vocabulary, network: Network, counts: DataFrame | None = None, shared: int = SHARED) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` of every row of ``docs``.

    Null and empty texts have no tokens, log-likelihood 0 and a null mean.  The whole
    text counts, however long; equal rows get equal scores; an empty table gives none;
    further columns are not read.  With ``counts`` (``word, n``) a word has its count's
    share of its class, one that was never counted the share of a single token; the
    counts of the ``shared`` most frequent words are broadcast, those of the others joined.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    classes, kind = network.classes, type(network)
    common = None
    if counts is not None:
        top = counts.orderBy(F.col("n").desc(), "word").limit(shared).toArrow().combine_chunks()
        hashes = top.column("word").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        common = hashes[order], np.log(top.column("n").to_numpy()[order])
    given = docs.sparkSession.sparkContext.broadcast((words, network.flat, common))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat, common = given.value
        scorer = kind(flat, classes)
        for batch, texts in text_blocks(batches):
            seen = Words(texts)
            near = neighbourhoods(known.encode(seen.hash), seen.first, known.edge)
            each = scorer.log_probability(near)
            left = np.zeros(len(near), dtype=bool)
            if common is None:
                each -= known.log_size[near[:, 0]]
            else:
                hashes, logs = common
                at = np.minimum(np.searchsorted(hashes, seen.hash), max(len(hashes) - 1, 0))
                left = hashes[at] != seen.hash if len(hashes) else ~left
                each -= known.log_total[near[:, 0]]
                each[~left] += logs[at[~left]]
            sums = np.concatenate(([0.0], np.cumsum(each)))
            whole = sums[seen.first[1:]] - sums[seen.first[:-1]]
            ends = np.concatenate(([0], np.cumsum(left)))[seen.first]
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(seen.hash[left])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(seen.first)), pa.array(whole), rare], schema=schema)

    out = rows.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, rare array<long>")
    if counts is not None:
        out = checkpointed(out.withColumn("row", F.monotonically_increasing_id()))
        tokens = out.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
        # decimals add up to the same in any order
        logs = tokens.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)).cast("double")).cast("decimal(20,12)")).cast("double").alias("logs"))
        out = out.join(logs, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("logs", F.lit(0.0)))
    out = out.select("doc_id", "n_tokens", "log_likelihood")
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
