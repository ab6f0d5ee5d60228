"""Runs of repeated word sequences, by an enhanced suffix array and branching tandems.

All texts of a block are sorted at once: suffixes by prefix doubling, the common prefixes
of neighbours from the ranks of each doubling.  A common prefix of d words splits its
interval of the suffix array in two; for each suffix i of the smaller side the inverse
array tells whether i + d or i - d is on the other side, and then two equal stretches of
d words touch and differ in the word that follows.  Every maximal run ends with exactly
one such square of its period; rotating it to the left, by the same ranks, finds the
run's start.  Intervals are pairs of array positions; no tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgrove.llm.common import text_blocks

#: The shortest run in words.
SHORTEST = 12
#: Suffixes that are tested by one array operation.
TESTED = 1 << 20
#: Rounds of pointer jumping before the rest is told by a stack.
JUMPS = 48

RUN = "array<struct<start:long,length:long,period:long>>"


class SuffixOrder:
    """Order, inverse and common prefixes of all suffixes of ``symbols``.

    Each text ends with a symbol that occurs nowhere else, so no common prefix reaches
    over an end.  ``ranks[k]`` tells stretches of 2**k symbols apart: equal ranks mean
    equal stretches.  ``common[j]`` is the common prefix of the suffixes at j - 1 and j.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = order = np.argsort(symbols)
        found = symbols[order]
        head = np.ones(n, dtype=bool)  # whether a group of equal stretches begins here
        head[1:] = found[1:] != found[:-1]
        born = np.where(head, 0, -1).astype(np.int8)  # the doubling that split two neighbours
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.ranks = [rank]
        slots = np.arange(n)
        while True:
            last = np.ones(len(slots), dtype=bool)
            last[:-1] = head[slots[1:]] | (slots[1:] != slots[:-1] + 1)
            slots = slots[~(head[slots] & last)]
            if not len(slots):
                break
            at = order[slots]
            key = rank[at].astype(np.int64) * n + rank[at + (1 << (len(self.ranks) - 1))]
            sort = np.argsort(key)
            key = key[sort]
            order[slots] = at[sort]
            first = np.ones(len(slots), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            born[slots[first & ~head[slots]]] = len(self.ranks)
            head[slots] = first
            rank = rank.copy()
            rank[order[slots]] = np.maximum.accumulate(np.where(first, slots, 0))
            self.ranks.append(rank)
        self.inverse = rank
        self.common = np.zeros(n + 1, dtype=np.int64)
        pairs = np.flatnonzero(born > 0)
        x, y, split = order[pairs - 1], order[pairs], born[pairs].astype(np.int64)
        length = np.left_shift(1, split - 1) if len(pairs) else split
        for level in range(len(self.ranks) - 3, -1, -1):
            some = np.flatnonzero(split >= level + 2)
            at = length[some]
            same = self.ranks[level][x[some] + at] == self.ranks[level][y[some] + at]
            length[some[same]] += 1 << level
        self.common[pairs] = length

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions j with a common prefix, and the bounds of what has it: [left, j) and [j, right).

        Of equal values in one interval the leftmost splits first, so two suffixes are
        parted at one position only, and there by their whole common prefix.
        """
        value = self.common
        where = np.flatnonzero(value > 0)
        left = np.arange(len(value)) - 1
        right = np.arange(len(value)) + 1
        for bound, beyond in ((left, np.greater), (right, np.greater_equal)):
            open_ = where
            for _ in range(JUMPS):
                open_ = open_[beyond(value[bound[open_]], value[open_])]
                if not len(open_):
                    break
                bound[open_] = bound[bound[open_]]
            else:
                _by_stack(value, bound, beyond is np.greater)
        return where, left[where], right[where]

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of every square that the next symbol does not continue."""
        split, left, right = self.intervals()
        depth = self.common[split]
        smaller = split - left <= right - split
        begin = np.where(smaller, left, split)
        size = np.where(smaller, split - left, right - split)
        low, high = np.where(smaller, split, left), np.where(smaller, right, split)
        ends = np.cumsum(size)
        starts, periods = [], []
        at = 0
        while at < len(split):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TESTED, side="right")))
            owner = np.repeat(np.arange(at, upto), size[at:upto])
            slot = begin[owner] + np.arange(len(owner)) - (ends - size)[owner] + (ends[at] - size[at])
            suffix, d = self.order[slot], depth[owner]
            for other, square in ((suffix + d, suffix), (suffix - d, suffix - d)):
                there = self.inverse[np.clip(other, 0, len(self.inverse) - 1)]
                hit = (there >= low[owner]) & (there < high[owner]) & (other >= 0) & (other < len(self.inverse))
                starts.append(square[hit])
                periods.append(d[hit])
            at = upto
        return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def rotated(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where the stretch of each period that contains the square begins."""
        start = start.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            to = start - (1 << level)
            some = np.flatnonzero(to >= 0)
            same = self.ranks[level][to[some]] == self.ranks[level][to[some] + period[some]]
            start[some[same]] = to[some[same]]
        return start


def _by_stack(value: np.ndarray, bound: np.ndarray, leftwards: bool) -> None:
    """Fill ``bound`` with the next position that is not beyond, in one pass."""
    held: list[int] = []
    values = value.tolist()
    for j in range(len(values)) if leftwards else range(len(values) - 1, -1, -1):
        mine = values[j]
        while held and (values[held[-1]] > mine or (not leftwards and values[held[-1]] == mine)):
            held.pop()
        bound[j] = held[-1] if held else (-1 if leftwards else len(values))
        held.append(j)


def word_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """The maximal runs of each text's words: rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    words = pa.chunked_array([pa.array([w for t in texts for w in t], pa.large_binary())]).combine_chunks().dictionary_encode()
    place = np.ones(int(sizes.sum()) + len(texts), dtype=bool)
    place[begins + sizes] = False
    symbols = np.repeat(np.arange(len(texts)), sizes + 1) * (len(words.dictionary) + 1)
    symbols[place] += words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    suffixes = SuffixOrder(symbols)
    start, period = suffixes.squares()
    end = start + 2 * period
    start = suffixes.rotated(start, period)
    long = end - start >= shortest
    start, end, period = start[long], end[long], period[long]
    sort = np.lexsort((period, end, start))  # multiples of a period make the same stretch
    start, end, period = start[sort], end[sort], period[sort]
    least = np.ones(len(start), dtype=bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    sort = np.lexsort((period, start))
    rows = np.stack([start, end - start, period], axis=1)[sort]
    cuts = np.searchsorted(rows[:, 0], np.append(begins, begins[-1] + sizes[-1] + 1)) if len(texts) else np.zeros(1, dtype=np.int64)
    return [rows[a:b] - np.array([begin, 0, 0]) for a, b, begin in zip(cuts[:-1], cuts[1:], begins, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(steps[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (``doc_id, text``).

    ``runs`` are all maximal periodic stretches of at least ``shortest`` words and twice
    their smallest period, by start, then period; ``collapsed`` is the text without the
    repetitions, words joined by one blank.  A null or empty text has no words, no runs
    and an empty ``collapsed``; a null id stays null; repeated rows give repeated rows;
    other columns are not read; an empty table gives an empty one.  A text is worked on
    whole, in one task: memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            words = [t.split() for t in texts]
            found = word_runs(words, shortest)
            kept = [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]
            flat = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")
