"""Ranked lexical search over a length-stratified index.

Documents with an equal length normaliser m form a stratum.  Within it the postings of a
term are grouped by term frequency, so the impact of a frequency is computed once per
stratum.  The largest impact of each term bounds what any document of the stratum can
score; strata are visited in the order of that bound until it falls below the k-th best
score.  The index is a table with one row per stratum and block of documents: a document
is in one row, so rows are searched where they are read and only the best move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgrove.llm.common import checkpointed, give_back, text_blocks

#: Bytes of text of one block of the index.
BLOCK_BYTES = 6 << 20
#: Bytes of item texts that are searched for in one pass over the index.
ITEM_BYTES = 8 << 20
#: Rows of the index that are read and sent to a worker at a time; one has tens of kilobytes.
ROWS = 128
#: Strata that every item visits in the first round; each next round visits four times as many.
FIRST = 4
#: Postings that are added up by one array operation.
ADDED = 1 << 19
#: Postings of the index rows that are searched together; a row has less than a block of text.
TOGETHER = 1 << 19

INDEX = "m long, docs array<long>, terms array<string>, groups array<int>, tf array<int>, sizes array<int>, members array<int>"
NO_ID = -(2**63)


def _separators() -> bytes:
    """Every byte that is no part of a term as a blank, A-Z as a-z, all others as they are."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(out)


TO_TERMS = _separators()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters above ASCII, only A-Z lower-cased."""
    return text.translate(TO_TERMS).split()


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms, of the binary column ``text``."""
    inside = np.frombuffer(TO_TERMS, dtype=np.uint8) != 0x20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for _, texts in text_blocks(batches):
            raw = inside[np.frombuffer(b" " + b" ".join(texts), dtype=np.uint8)]
            starts = np.flatnonzero(raw[1:] & ~raw[:-1])
            begins = np.cumsum([0] + [len(t) + 1 for t in texts])
            each = np.diff(np.searchsorted(starts, begins))
            docs += int((each > 0).sum())
            terms += int(each.sum())
        yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})

    row = docs.mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


class _Block:
    """Documents that become index rows together."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.coded: list[pa.DictionaryArray] = []
        self.held = 0

    def add(self, ids: np.ndarray, texts: list[bytes]) -> None:
        terms = [terms_of(t) for t in texts]
        self.ids.append(ids)
        self.lengths.append(np.array([len(t) for t in terms], dtype=np.int64))
        self.coded.append(pa.array([x for t in terms for x in t], pa.binary()).dictionary_encode())
        self.held += sum(map(len, texts))

    def rows(self) -> pa.RecordBatch | None:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        some = lengths > 0
        if not some.any():
            return None
        coded = pa.chunked_array(self.coded).unify_dictionaries()
        names = coded.chunk(0).dictionary
        term = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]).astype(np.int64)
        ids, lengths = ids[some], lengths[some]
        sizes, of = np.unique(lengths, return_inverse=True)
        m = np.array([10 + 90 * int(n) * self.n_docs // self.n_terms for n in sizes], dtype=np.int64)[of]
        strata, of = np.unique(m, return_inverse=True)
        order = np.argsort(of, kind="stable")  # documents by stratum
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        first_doc = np.searchsorted(of[order], np.arange(len(strata) + 1))
        # one posting for each document and term
        pair, tf = np.unique(np.repeat(place, lengths) * len(names) + term, return_counts=True)
        doc, term = pair // len(names), pair % len(names)
        stratum = of[order][doc]
        key = stratum * len(names) + term
        by = np.lexsort((tf, key))  # stable: documents stay in order
        key, tf, doc, stratum = key[by], tf[by], doc[by], stratum[by]
        new_term = np.ones(len(key), dtype=bool)
        new_term[1:] = key[1:] != key[:-1]
        new_group = new_term.copy()
        new_group[1:] |= tf[1:] != tf[:-1]
        at_term, at_group = np.flatnonzero(new_term), np.flatnonzero(new_group)
        ends = np.arange(len(strata) + 1)
        terms_at, groups_at, postings_at = np.searchsorted(stratum[at_term], ends), np.searchsorted(stratum[at_group], ends), np.searchsorted(stratum, ends)
        groups_of_term = np.diff(np.append(np.searchsorted(at_group, at_term), len(at_group)))
        columns = [
            pa.array(strata), lists(first_doc, pa.array(ids[order])), lists(terms_at, names.take(pa.array(key[at_term] % len(names))).cast(pa.string())),
            lists(terms_at, pa.array(groups_of_term.astype(np.int32))), lists(groups_at, pa.array(tf[at_group].astype(np.int32))),
            lists(groups_at, pa.array(np.diff(np.append(at_group, len(key))).astype(np.int32))), lists(postings_at, pa.array((doc - first_doc[stratum]).astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["m", "docs", "terms", "groups", "tf", "sizes", "members"])


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The index of ``doc_id, text`` and the number of documents with terms.

    One row holds the documents of a stratum in one block of at least ``block_bytes`` of
    text: their ids, the stratum's terms, and for each term its groups of equal frequency
    (``groups`` a term, ``tf`` and ``sizes`` a group) with the members' places in ``docs``.
    Null ids count as the smallest number.  The rows are a table in the shared folder.
    """
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    n_docs, n_terms = corpus_counts(given.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(n_docs, n_terms)
        for batch, texts in text_blocks(batches):
            block.add(batch.column("doc_id").to_numpy(), texts)
            if block.held >= block_bytes:
                rows, block = block.rows(), _Block(n_docs, n_terms)
                if rows is not None:
                    yield rows
                give_back()
        rows = block.rows() if block.ids else None
        if rows is not None:
            yield rows

    return checkpointed(given.mapInArrow(run, INDEX)), n_docs


def weight(n_docs: int, holding: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Items:
    """Items as the terms they ask for: ``owners[starts[t]:starts[t + 1]]`` are the items with term t."""

    def __init__(self, texts: list[str | None]):
        asked = [sorted(set(terms_of((t or "").encode()))) for t in texts]
        self.terms = sorted({t for x in asked for t in x})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, x in enumerate(asked) for t in x)
        self.owners = np.array([i for _, i in pairs], dtype=np.int64)
        self.starts = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(self.terms) + 1))
        self.count = len(texts)

    def names(self) -> pa.Array:
        return pa.array([t.decode() for t in self.terms], pa.string())


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: the number of the range, and each place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, starts[owner] + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


def flat(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    column = batch.column(name)
    return column.flatten(), np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths()))))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the index with about TOGETHER postings each."""
    for batch in batches:
        piece = np.cumsum(np.asarray(batch.column("members").value_lengths())) // TOGETHER
        cuts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True]))) if len(piece) else piece
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        give_back()


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.ones(items, dtype=np.int64)  # a score of 0 does not count

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        near = score >= self.least[item]
        item, score, doc = (np.concatenate(x) for x in ((self.item, item[near]), (self.score, score[near]), (self.doc, doc[near])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.item, self.score, self.doc = (x[rank < self.k] for x in (item, score, doc))
        full = rank == self.k - 1
        self.least[item[full]] = np.maximum(score[full], 1)


class Strata:
    """Rows of the index, with what the asked terms have in them."""

    def __init__(self, batch: pa.RecordBatch, names: pa.Array):
        m = batch.column("m").to_numpy()
        terms, terms_at = flat(batch, "terms")
        tf, groups_at = flat(batch, "tf")
        self.tf = tf.to_numpy().astype(np.int64)
        self.sizes = np.asarray(flat(batch, "sizes")[0]).astype(np.int64)
        docs, self.docs_at = flat(batch, "docs")
        self.docs = docs.to_numpy()
        self.members = np.asarray(flat(batch, "members")[0])
        groups = np.asarray(flat(batch, "groups")[0]).astype(np.int64)
        self.members_at = np.cumsum(self.sizes) - self.sizes
        # one impact for each stratum and frequency
        of_group = np.repeat(np.arange(len(m)), np.diff(groups_at))
        each, back = np.unique(of_group * (int(self.tf.max(initial=0)) + 1) + self.tf, return_inverse=True)
        stratum, f = each // (int(self.tf.max(initial=0)) + 1), each % (int(self.tf.max(initial=0)) + 1)
        self.impact = ((1_000_000_000 * f) // (1000 * f + 8 * m[stratum]))[back]
        asked = pc.index_in(terms, value_set=names)
        mine = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
        self.term = asked.take(pa.array(mine)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.stratum = np.searchsorted(terms_at, mine, side="right") - 1
        self.group_at = (np.cumsum(groups) - groups)[mine]
        self.groups = groups[mine]
        self.count = len(m)

    def holding(self, terms: int) -> np.ndarray:
        """Documents with each asked term."""
        owner, group = spread(self.group_at, self.groups)
        return np.bincount(self.term[owner], weights=self.sizes[group], minlength=terms).astype(np.int64)

    def search(self, items: Items, weights: np.ndarray, best: Best) -> None:
        """Visit the strata of every item by falling bound until none can enter its best."""
        if not len(self.term):
            return
        most = weights[self.term] * self.impact[self.group_at + self.groups - 1]
        entry, owner = spread(items.starts[self.term], np.diff(items.starts)[self.term])
        item = items.owners[owner]
        order = np.argsort(item * self.count + self.stratum[entry], kind="stable")
        entry, item = entry[order], item[order]
        pair = item * self.count + self.stratum[entry]
        begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        bound = np.add.reduceat(most[entry], begin)
        total = np.concatenate(([0], np.cumsum(self.sizes)))
        postings = np.add.reduceat((total[self.group_at + self.groups] - total[self.group_at])[entry], begin)
        size = np.diff(np.append(begin, len(entry)))
        asks = item[begin]
        order = np.lexsort((-bound, asks))
        begin, bound, size, asks, postings = begin[order], bound[order], size[order], asks[order], postings[order]
        rank = np.arange(len(asks)) - np.searchsorted(asks, asks)
        upto = FIRST
        left = np.arange(len(asks))
        while len(left):
            left = left[bound[left] >= best.least[asks[left]]]
            now, left = left[rank[left] < upto], left[rank[left] >= upto]
            upto *= 4
            piece = np.cumsum(postings[now]) // ADDED
            cuts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True]))) if len(now) else now
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self._visit(now[a:b], begin, size, asks, entry, weights, best)

    def _visit(self, pairs, begin, size, asks, entry, weights, best) -> None:
        """Add up the impacts of whole strata for the items that ask."""
        pair, at = spread(begin[pairs], size[pairs])
        which = entry[at]
        owner, group = spread(self.group_at[which], self.groups[which])
        gain = weights[self.term[which]][owner] * self.impact[group]
        inner, at = spread(self.members_at[group], self.sizes[group])
        doc = self.docs_at[self.stratum[which]][owner][inner] + self.members[at]
        key = asks[pairs][pair][owner][inner] * len(self.docs) + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        score = np.add.reduceat(gain[inner[order]], first)
        best.add(key[first] // len(self.docs), score, self.docs[key[first] % len(self.docs)])


@contextmanager
def wide_rows(session: SparkSession, rows: int = ROWS):
    """While jobs over wide rows run, batches hold few of them: Spark counts rows, not bytes."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    given = {key: session.conf.get(key) for key in keys}
    try:
        for key in keys:
            session.conf.set(key, str(min(rows, int(given[key])) if int(given[key]) > 0 else rows))
        yield
    finally:
        for key in keys:
            session.conf.set(key, given[key])


def search(index: DataFrame, n_docs: int, items: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    """``item_id, doc_id, score``: the k best documents of each item in every task's part of the index."""
    session = index.sparkSession
    asked = Items([text for _, text in items])
    names = session.sparkContext.broadcast(asked.names())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(names.value), dtype=np.int64)
        for rows in together(batches):
            out += Strata(rows, names.value).holding(len(out))
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["term", "n"])

    holding = np.zeros(len(asked.terms), dtype=np.int64)
    with wide_rows(session):
        for row in index.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # asked terms only
            holding[row["term"]] = row["n"]
    weights = np.array([weight(n_docs, int(n)) for n in holding], dtype=np.int64)
    given = session.sparkContext.broadcast((asked, weights, [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, ids = given.value
        best = Best(asked.count, k)
        for rows in together(batches):
            Strata(rows, names.value).search(asked, weights, best)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.doc), pa.array(best.score)], names=["item_id", "doc_id", "score"])
        give_back()

    with wide_rows(session):
        return checkpointed(index.mapInArrow(run, "item_id long, doc_id long, score long"))


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items as lists of about ``most_bytes`` of text: one at a time is held by the driver and sent to the tasks."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // most_bytes))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]


def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best of all ``docs`` (``doc_id, text``) for each of ``items`` (``item_id, text``).

    Scores above 0 only; equal scores by ascending doc_id, a null id first.  A null or
    empty text has no terms: such a document counts nowhere, such an item has no rows.
    Repeated documents are ranked as often as they occur.  Of several rows with one item
    id (null is one id) the least text asks.  Other columns are not read; an empty table
    on either side gives an empty result.
    """
    index, n_docs = build(docs, block_bytes)
    asks = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    found = None
    for block in item_blocks(asks.where(F.col("text").isNotNull()), item_bytes):
        part = search(index, n_docs, block, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
