"""Similarity join on shingle sets with token-combination prefixes.

Shingles are ordered by the number of sets that hold them, rare before frequent.  Two
sets with enough overlap share their first common shingle early in that order, so a
set indexes its prefix: rare shingles one by one, frequent ones (common passages,
groups of near copies) in combinations of two from the same class, with the prefix
extended by the number of classes so that two shared shingles must fall into one
class.  Candidates that pass the size and position filters are verified on whole sets.

Most sets link with nothing.  Two extended prefixes find that out before anything is
indexed.  By hash order, two linked sets share ``k`` shingles of their first
``n - overlap + k``; a set of which fewer than ``k`` such shingles occur in another set
is out.  Of the sets that are left all shingles are counted, which gives the order, and
a set with too few shared ones is out as well.

Shingles travel as packed arrays by hash range, so that no row is made for a shingle.
Equal sets form one class before anything else, so exact copies cost one member.
Within a signature every member is compared with a pivot, the member where the
signature stands earliest.  Members that the found links leave in different components
meet more pivots of their signature, MORE times as many each round, until every
signature lies in one component or all its members have been pivots.  These joins
compare parity sketches themselves, so that a pair becomes a row only where its sketches
leave a link possible.  No link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgrove.llm.common import Words, checkpointed, components, forget, give_back, in_bitmap, marked, mix, signed, sized_bitmap, text_blocks

WORDS = 5
#: Similarity 0.75 as a fraction, so that comparisons stay in whole numbers.
SHARE = (3, 4)
#: A shingle is frequent from so many sets on.
FREQUENT = 16
#: The first prefix is extended by one shingle for so many of a set.
SPARE = 16
#: Shingles and sets that a task gathers before it deals them out by hash range, and shingles of one range.
GATHER, GATHER_SETS, RANGE = 800_000, 60_000, 1 << 19
#: A shingle is heavy from the share 2**-HEAVY_BITS of all shingles on (HEAVY_LEAST at least), so at most 2**HEAVY_BITS
#: are: these few need no counting and are never gathered.  Only repetitions of LOCAL or more in one gather are counted.
HEAVY_BITS, HEAVY_LEAST, LOCAL = 18, 256, 8
#: Members of a signature that are pivots in the second round, and how many times as many are in each later one.
PIVOTS, MORE = 32, 8

_MANY = 65535
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


class Sets:
    """Shingle sets of a block of texts: set i is ``values[first[i]:first[i + 1]]``, sorted.

    A text with fewer than ``words`` words is one shingle, one without words has none.
    """

    def __init__(self, texts: list[bytes], words: int = WORDS):
        seen = Words(texts, lower=True)
        rolled, inside = seen.windows(words)
        counts = np.diff(seen.first)
        sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        at = np.concatenate(([0], np.cumsum(sizes)))
        values = np.empty(int(at[-1]), dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        values[(counts >= words)[owner]] = rolled[inside]
        for i in np.flatnonzero((counts > 0) & (counts < words)):
            value = counts[i : i + 1].astype(np.uint64)
            for k in range(int(seen.first[i]), int(seen.first[i + 1])):
                value = mix(value * _ODD[1] + seen.hash[k : k + 1])
            values[at[i]] = value[0]
        for i in np.flatnonzero(sizes > 1):
            values[at[i] : at[i + 1]].sort()
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        sums = np.zeros(len(self.values) + 1, dtype=np.uint64)
        np.cumsum(mix(self.values ^ _ODD[2]), out=sums[1:])
        #: a 64-bit key of every set, as a signed number
        self.keys = signed(mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(np.uint64) * _ODD[3]))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]

    def unseen(self, known: set[int]) -> np.ndarray:
        """Which sets have a key that ``known`` lacks; adds them."""
        out = np.zeros(len(self.keys), dtype=bool)
        for i, key in enumerate(self.keys.tolist()):
            if key not in known:
                known.add(key)
                out[i] = True
        return out


def least_overlap(n, share: tuple[int, int] = SHARE):
    """Shingles that a set of size n shares with every set it links with, at least."""
    return -(n * -share[0] // share[1])


def parity(values: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of at least 2 * n places, a power of two, 64 in a number.

    Each shingle that only one of two sets has flips one place, so the sketches of
    two sets differ in no more places than the sets have such shingles.
    """
    places = max(64, 1 << int(2 * len(values) - 1).bit_length())
    at = (mix(values ^ _ODD[1]) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places).astype(np.uint8) & 1).view(np.int64)


def apart(a: Column, b: Column) -> Column:
    """Places in which two parity sketches differ; one of twice the places is folded, beyond that nothing is known (0)."""
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, c: n + c)
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda u, v: u.bitwiseXOR(v))
    twice = lambda x, y: F.size(x) == 2 * F.size(y)
    return F.when(F.size(a) == F.size(b), differ(a, b)).when(twice(a, b), differ(folded(a), b)).when(twice(b, a), differ(a, folded(b))).otherwise(0)


def _limits(share: tuple[int, int], n: int) -> list[float]:
    """Lower ends of the bands of set sizes up to the one above n: sizes that can link lie at most one band apart."""
    out = [1.0]
    while out[-1] <= n:
        out.append(out[-1] * share[1] / share[0])
    return [*out, out[-1] * share[1] / share[0]]


def _groups(low: float) -> int:
    """Classes of frequent shingles in the band that starts at ``low``; more of them mean fewer combinations."""
    return max(1, int(low / 24))


def signatures(ordered: np.ndarray, alone: int, rares: int, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set with their places and slacks.

    ``ordered`` has the shingles in the common order: the first ``alone`` are in no other
    set, the first ``rares`` are not frequent.  A pair that shares a signature has an
    overlap of at most slack + min(n1 - place1, n2 - place2) - 1, or shares another
    signature for which that holds.
    """
    n = len(ordered)
    prefix = n - least_overlap(n, share) + 1 if n > 1 else 0
    at = np.arange(alone, max(alone, min(rares, prefix)))
    sigs, places, slacks = [mix(ordered[at] ^ _ODD[0])], [at], [np.ones(len(at), np.int64)]
    if rares < prefix:
        common, limits = ordered[rares:], _limits(share, n)
        own = len(limits) - 3
        # the band of the larger set of a pair: this one's own, or the next, where the other set is at least so large
        for band, least in ((own, 0.0), (own + 1, (n + limits[own + 1]) * share[0] / (share[0] + share[1]))):
            groups = _groups(limits[band])
            some = common[: max(0, min(prefix, n - int(least - 1e-6)) + groups - rares)]
            group = (mix(some ^ _ODD[1]) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(starts) > 1):
                inside = order[starts[g] : starts[g + 1]]
                i, j = _pairs(len(inside))
                i, j = inside[i], inside[j]
                sigs.append(mix(some[i] * _ODD[1] + some[j] * _ODD[2] + np.uint64(band)))
                places.append(rares + j)
                slacks.append(np.full(len(i), groups + 1))
    return tuple(map(np.concatenate, (sigs, places, slacks)))


@lru_cache(64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _columns(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def _surveyor(words: int):
    """Keys and sizes of all sets, and the shingles that many sets of a gather hold."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "n", "token")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        known: set[int] = set()
        size = 0

        def repeated():
            tokens = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))
            counts = np.diff(edge)
            tokens, counts = tokens[edge[:-1]][counts >= LOCAL], counts[counts >= LOCAL]
            none = pa.nulls(len(tokens), pa.int64())
            return _columns(schema, none, none, counts, signed(tokens))

        for batch, texts in text_blocks(batches):
            sets = Sets(texts, words)
            yield _columns(schema, batch.column("doc_id"), sets.keys, sets.sizes, pa.nulls(len(texts), pa.int64()))
            held.append(sets.values[sets.unseen(known)[sets.owner]])
            size += len(held[-1])
            if size > GATHER:
                yield repeated()
                held, known, size = [], set(), 0
        if size:
            yield repeated()

    return run


PACKED = "part int, heavy boolean, tokens binary, owners binary, keys binary, hits binary"
_packed = pa.schema([("part", pa.int32()), ("heavy", pa.bool_()), *[(c, pa.binary()) for c in ("tokens", "owners", "keys", "hits")]])


def _short(tokens: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each token below its range."""
    return ((tokens << np.uint64(bits)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _gathered(batches: Iterator[pa.RecordBatch], words: int, taken) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, their owners' numbers and the keys of the different sets of about GATHER tokens; ``taken(sets)`` says which tokens."""
    tokens, owners, keys = [], [], []
    known: set[int] = set()
    size = count = 0
    for _, texts in text_blocks(batches):
        sets = Sets(texts, words)
        fresh = sets.unseen(known) & (sets.sizes > 1)
        use = taken(sets) & fresh[sets.owner]
        number = np.cumsum(fresh) - 1 + count
        tokens.append(sets.values[use])
        owners.append(number[sets.owner[use]])
        keys.append(sets.keys[fresh])
        size, count = size + len(tokens[-1]), count + int(fresh.sum())
        if size > GATHER or count > GATHER_SETS:
            yield np.concatenate(tokens), np.concatenate(owners), np.concatenate(keys)
            tokens, owners, keys, known, size, count = [], [], [], set(), 0, 0
    if size:
        yield np.concatenate(tokens), np.concatenate(owners), np.concatenate(keys)


def _spread(tokens: np.ndarray, owners: np.ndarray, keys: np.ndarray, bits: int, pack) -> Iterator[tuple]:
    """Sorted tokens by range, each with a table of its own of the owners' keys; owner -1 stands for several."""
    edge = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for part in np.flatnonzero(np.diff(edge)):
        own = owners[edge[part] : edge[part + 1]]
        used, number = np.unique(own[own >= 0], return_inverse=True)
        short = np.full(len(own), _MANY, dtype=np.uint16)
        short[own >= 0] = number
        yield part, False, pack(tokens[edge[part] : edge[part + 1]]), short.tobytes(), keys[used].tobytes(), None


def _offering(words: int, share: tuple[int, int], bits: int):
    """Extended prefixes by hash range: a token that several sets of the gather hold once, and how many such tokens each set has."""

    def taken(sets: Sets) -> np.ndarray:
        rank = np.arange(len(sets.values)) - sets.first[:-1][sets.owner]
        return rank < _first_prefix(sets.sizes, share)[0][sets.owner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, owners, keys in _gathered(batches, words, taken):
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            single = np.diff(np.concatenate((start, [len(tokens)]))) == 1
            several = ~np.repeat(single, np.diff(np.concatenate((start, [len(tokens)]))))
            hits = np.bincount(owners[several], minlength=len(keys))
            rows = list(_spread(tokens[start], np.where(single, owners[start], -1), keys, bits, lambda t: _short(t, bits)))
            some = np.flatnonzero(hits)
            rows.append((int(keys[0]) % (1 << bits), False, b"", b"", keys[some].tobytes(), hits[some].astype(np.uint32).tobytes()))
            yield _columns(_packed, *zip(*rows, strict=True))

    return run


def _first_prefix(n, share: tuple[int, int]):
    """Length of the extended prefix by hash order, and the shared tokens that a set needs in it."""
    rest = n - least_overlap(n, share)
    length = np.minimum(n, rest + np.maximum(1, n // SPARE))
    return length, length - rest


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part of a partition that is sorted by part."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now and held:
                yield now, held
                held = []
            now = row["part"]
            held.append(row)
        give_back()
    if held:
        yield now, held
    give_back()


def _by_part(df: DataFrame) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part")


def _tallying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, hits``: for every set how many of its offered tokens another set offers too, in this range; copies may count twice."""
    schema = pa.schema([("key", pa.int64()), ("hits", pa.int64())])
    for _, rows in _runs(batches):
        tokens, owners, keys, hits = [], [], [], []
        for row in rows:
            table = np.frombuffer(row["keys"], dtype=np.int64)
            if row["hits"] is not None:
                keys.append(table)
                hits.append(np.frombuffer(row["hits"], dtype=np.uint32).astype(np.int64))
                continue
            own = np.frombuffer(row["owners"], dtype=np.uint16)
            tokens.append(_long(row["tokens"]) << np.uint64(1) | (own == _MANY))
            owners.append(np.concatenate((table, [0]))[np.minimum(own, len(table))])
        if tokens:
            t, o = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(t, kind="stable")
            t, o = t[order], o[order]
            many = (t & np.uint64(1)).astype(bool)
            start = np.flatnonzero(np.concatenate(([True], t[1:] >> np.uint64(1) != t[:-1] >> np.uint64(1))))
            length = np.diff(np.concatenate((start, [len(t)])))
            shared = np.logical_or.reduceat(many, start) | (np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start))
            own = o[np.repeat(shared, length) & ~many]
            keys.append(own)
            hits.append(np.ones(len(own), dtype=np.int64))
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        yield _columns(schema, k, np.bincount(at, weights=np.concatenate(hits), minlength=len(k)).astype(np.int64))


def _telling(words: int, bits: int, heavy: Broadcast, alive: Broadcast | None):
    """All tokens by hash range; heavy ones are dealt by key, for they are not counted.  With a bitmap only of the rows whose id's bits are set."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(alive.value, batch.column("id_hash").to_numpy(zero_copy_only=False).view(np.uint64)))) if alive else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, owners, keys in _gathered(chosen(batches), words, lambda sets: np.ones(len(sets.values), dtype=bool)):
            known = heavy.value
            at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            much = known[at] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
            light = np.flatnonzero(~much)
            light = light[np.argsort(tokens[light], kind="stable")]
            rows = list(_spread(tokens[light], owners[light], keys, bits, np.ndarray.tobytes))
            part = mix(keys.view(np.uint64)[owners[much]]) >> np.uint64(64 - bits)
            order = np.argsort(part, kind="stable")
            t, o, part = tokens[much][order], owners[much][order], part[order]
            edge = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edge)):
                used, number = np.unique(o[edge[p] : edge[p + 1]], return_inverse=True)
                rows.append((p, True, t[edge[p] : edge[p + 1]].tobytes(), number.astype(np.uint16).tobytes(), keys[used].tobytes(), None))
            yield _columns(_packed, *zip(*rows, strict=True))

    return run


def _answering(bits: int):
    """Tokens with the number of sets that hold them (``owners``; heavy ones count as 65535), dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            parts: list[tuple] = []
            for much in (False, True):
                some = [r for r in rows if r["heavy"] == much]
                if not some:
                    continue
                t = np.concatenate([np.frombuffer(r["tokens"], dtype=np.uint64) for r in some])
                k = np.concatenate([np.frombuffer(r["keys"], dtype=np.int64)[np.frombuffer(r["owners"], dtype=np.uint16)] for r in some])
                order = np.lexsort((k, t))
                t, k = t[order], k[order]
                new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
                t, k = t[new], k[new]
                start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                length = np.diff(np.concatenate((start, [len(t)])))
                parts.append((t, k, np.repeat(np.minimum(length, _MANY) if not much else np.full(len(length), _MANY), length)))
            t, k, n = map(np.concatenate, zip(*parts, strict=True))
            bucket = mix(k.view(np.uint64)) >> np.uint64(64 - bits)
            order = np.lexsort((k, bucket))
            t, k, n, bucket = t[order], k[order], n[order].astype(np.uint16), bucket[order]
            edge = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))
            out = []
            for b in np.flatnonzero(np.diff(edge)):
                at = slice(edge[b], edge[b + 1])
                used, counts = np.unique(k[at], return_counts=True)
                out.append((b, False, t[at].tobytes(), n[at].tobytes(), used.tobytes(), counts.astype(np.uint32).tobytes()))
            yield _columns(_packed, *zip(*out, strict=True))

    return run


ORDERED = "key long, n int, alone int, rares int, sketch array<long>, tokens array<long>"


def _ordering(share: tuple[int, int], frequent: int):
    """Whole sets in the common order, of those that share enough shingles with others."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema([(f.split()[0], t) for f, t in zip(ORDERED.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            t = np.concatenate([np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows])
            c = np.concatenate([np.frombuffer(r["owners"], dtype=np.uint16) for r in rows])
            k = np.concatenate([np.repeat(np.frombuffer(r["keys"], dtype=np.int64), np.frombuffer(r["hits"], dtype=np.uint32)) for r in rows])
            c = np.minimum(c, frequent)
            order = np.lexsort((t, c, k))
            t, c, k = t[order], c[order], k[order]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            t, c, k = t[new], c[new], k[new]
            start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            n = np.diff(np.concatenate((start, [len(k)])))
            alone, rares = np.add.reduceat((c == 1).astype(np.int64), start), np.add.reduceat((c < frequent).astype(np.int64), start)
            keep = np.flatnonzero((n > 1) & (n - alone >= least_overlap(n, share)))
            for a in range(0, len(keep), 2000):
                some = keep[a : a + 2000]
                sets = [t[start[i] : start[i] + n[i]] for i in some]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32)), pa.array(signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([pa.array(k[start[some]]), pa.array(n[some], pa.int32()), pa.array(alone[some], pa.int32()), pa.array(rares[some], pa.int32()), pa.array([parity(x) for x in sets], pa.list_(pa.int64())), lists], schema=schema)

    return run


def _indexing(share: tuple[int, int]):
    schema = pa.schema([("sig", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("slack", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                found = [signatures(x.values.to_numpy().view(np.uint64), alone, rares, share) for x, alone, rares in zip(batch.column("tokens"), batch.column("alone").to_pylist(), batch.column("rares").to_pylist(), strict=True)]
                if found:
                    sigs, places, slacks = map(np.concatenate, zip(*found, strict=True))
                    count = [len(f[0]) for f in found]
                    yield _columns(schema, signed(sigs), np.repeat(batch.column("key").to_numpy(), count), np.repeat(batch.column("n").to_numpy(), count), places.astype(np.int32), slacks.astype(np.int32))

    return run


class Join:
    """One join over ``docs``; ``result()`` gives the component of every document."""

    def __init__(self, docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, frequent: int = FREQUENT):
        self.words, self.share, self.frequent = words, share, frequent
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash"), F.col("text").cast("string").cast("binary").alias("text"))
        self.context = docs.sparkSession.sparkContext

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """``doc_id, key, n`` of every document, and ``token, n`` of the shingles that many sets of a gather hold."""
        survey = checkpointed(self.rows.select("doc_id", "text").mapInArrow(_surveyor(self.words), "doc_id long, key long, n long, token long"))
        return survey.where(F.col("key").isNotNull()).drop("token"), survey.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))

    def _bits(self, tokens: int) -> int:
        return max(6, int(tokens // RANGE).bit_length())

    def sets(self, reps: DataFrame, often: DataFrame) -> DataFrame:
        """Whole sets, in the common order, of all documents that can link with another."""
        low, high = self.share
        total = reps.agg(F.sum("n")).first()[0] or 0
        bits = self._bits(total * (high - low) // high + total // SPARE)
        offers = self.rows.select("text").mapInArrow(_offering(self.words, self.share, bits), PACKED)
        hits = _by_part(offers).mapInArrow(_tallying, "key long, hits long").groupBy("key").agg(F.sum("hits").alias("hits"))
        rest = F.col("n") - F.ceil(F.col("n") * low / high)
        needed = F.least(F.col("n"), rest + F.greatest(F.lit(1), F.floor(F.col("n") / SPARE))) - rest
        alive = checkpointed(hits.join(reps, "key").where(F.col("hits") >= needed).select("rep", "n"))
        size, some = alive.agg(F.sum("n"), F.count(F.lit(1))).first()
        heavy = often.where(F.col("n") >= max(HEAVY_LEAST, total >> HEAVY_BITS)).select("token").toArrow().column("token").combine_chunks().to_numpy().view(np.uint64)
        bits = self._bits(size or 0)
        ids = alive.select(F.xxhash64("rep").alias("id_hash"))
        bitmap = sized_bitmap(ids, some)
        rows = self.rows if bitmap is not None else self.rows.join(ids.distinct(), "id_hash", "left_semi")
        telling = _telling(self.words, bits, self.context.broadcast(np.sort(heavy)), None if bitmap is None else self.context.broadcast(bitmap))
        told = _by_part(rows.select("id_hash", "text").mapInArrow(telling, PACKED)).mapInArrow(_answering(bits), PACKED)
        return checkpointed(_by_part(told).mapInArrow(_ordering(self.share, self.frequent), ORDERED))

    def _possible(self, left: Column, right: Column) -> Column:
        """The size and position filters for two members of a signature."""
        low, high = self.share
        n, m = left["n"], right["n"]
        rest = F.least(n - left["place"], m - right["place"]) - 1
        enough = (n + m) * low <= (F.greatest(left["slack"], right["slack"]) + rest) * (low + high)
        return (F.least(n, m) * high >= F.greatest(n, m) * low) & enough

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that link, decided on whole sets."""
        ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        some = sets.select("key", "tokens").join(ends, "key", "left_semi")
        full = pairs.join(some.select(F.col("key").alias("a"), F.col("tokens").alias("set_a")), "a").join(some.select(F.col("key").alias("b"), F.col("tokens").alias("set_b")), "b")
        tested = full.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
        return checkpointed(tested.where(F.col("both") * self.share[1] >= (F.col("sum") - F.col("both")) * self.share[0]).select("a", "b"))

    def _alike(self, left: Column, right: Column) -> Column:
        """Whether the sketches of two sets differ in no more places than those of a linked pair can."""
        low, high = self.share
        return apart(left["sketch"], right["sketch"]) * (high + low) <= (left["n"] + right["n"]) * (high - low)

    def links(self, sets: DataFrame) -> DataFrame | None:
        """``node, component`` of the keys that have a link; None without candidates."""
        index = checkpointed(sets.mapInArrow(_indexing(self.share), "sig long, key long, n int, place int, slack int"))
        member = F.struct("place", "key", "n", "slack")
        span = checkpointed(index.groupBy("sig").agg(F.min(member).alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"))
        own, pivot = F.col("own"), F.col("pivot")
        ends = [F.least("own.key", "pivot.key").alias("a"), F.greatest("own.key", "pivot.key").alias("b")]
        pairs = index.select("sig", member.alias("own")).join(span.select("sig", "pivot"), "sig").where(self._possible(own, pivot)).select(*ends).where("a != b").distinct()
        a, b = (sets.select(F.col("key").alias(k), F.struct("sketch", "n").alias(end)) for k, end in (("a", "own"), ("b", "pivot")))
        tested = [checkpointed(pairs.join(a, "a").join(b, "b").where(self._alike(own, pivot)).select("a", "b"))]
        found = [self.verified(tested[0], sets)]
        # two members are decided by this round; the others go on
        index = index.join(span.where("members > 2").select("sig"), "sig", "left_semi")
        label = components(found[0])
        sketches = sets.select("key", "sketch")
        member = F.struct("place", "key", "n", "slack", "sketch")
        turn, pivots = 1, PIVOTS
        while True:
            left = index.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
            # a signature whose members are all connected has nothing left to decide, now or later
            span = left.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low != high").select("sig", "members")
            left = checkpointed(left.join(span, "sig").join(sketches, "key"))
            if left.isEmpty():
                return label
            # about ``pivots`` members by hash; from a small signature all
            chosen = F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 33) * F.col("members") < F.lit(pivots << 31)
            some = left.where(chosen).select("sig", member.alias("pivot"), F.col("component").alias("its"))
            other = left.select("sig", member.alias("own"), "component", chosen.alias("too"))
            fresh = (F.col("component") != F.col("its")) & (~F.col("too") | (F.col("own.key") < F.col("pivot.key")))
            # the join itself compares the sketches, so only pairs that they do not rule out become rows
            near = other.join(some, (other["sig"] == some["sig"]) & fresh & self._possible(own, pivot) & self._alike(own, pivot)).select(*ends).distinct()
            for old in tested:
                near = near.join(old, ["a", "b"], "left_anti")
            tested.append(checkpointed(near))
            found.append(self.verified(tested[-1], sets))
            if not found[-1].isEmpty():
                label = components(reduce(DataFrame.unionByName, found))
            # a pivot has met all members of its signature
            index = left.where(~chosen).select("sig", "key", "n", "place", "slack")
            turn, pivots = turn + 1, pivots * MORE

    def result(self) -> DataFrame:
        members, often = self.classes()
        reps = checkpointed(members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
        label = self.links(self.sets(reps, often))
        grouped = reps.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = grouped.join(least, "component").select("key", "component_id")
        filled = members.select("doc_id", "key", "n").join(named, "key", "left")
        return filled.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A-Z count as a-z; words are runs without ASCII white space.  A document without
    words (or null text) has an empty set and links with nothing: its component is
    its own id.  Rows that repeat an id are documents of their own; null ids are
    passed over when a component takes its smallest id.  Very long texts are read
    whole; an empty table gives an empty result; further columns are not read.
    """
    return Join(docs, words, share).result()


def first_of_each(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows that stay when one document of each component does: its smallest id.

    Documents without words all stay.  Of rows that repeat the smallest id one stays,
    the first by its text's and its other columns' hash.  Rows without an id and rows
    whose id repeats or does not stay are looked up, the others pass as they are.
    Columns may have any name and any type.
    """
    found = near_duplicates(docs, words, share)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), stays.alias("stays"), F.min("n_shingles").alias("least"))
    doubtful = checkpointed(per.where(~F.col("stays") | (F.col("rows") > 1) | F.col("doc_id").isNull()))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash"))
    ids = doubtful.select(F.xxhash64("doc_id").alias("id_hash"))
    count = doubtful.count()
    clean = marked(rows, "id_hash", ids, count, inside=False).select("row")
    held = marked(rows, "id_hash", ids, count).join(doubtful, F.col("own_id").eqNullSafe(F.col("doc_id")), "left")
    order = Window.partitionBy("own_id").orderBy(F.xxhash64(F.to_json("row")), F.to_json("row"))
    rest = held.where(F.coalesce("stays", F.lit(True))).withColumn("at", F.row_number().over(order)).where((F.col("at") == 1) | (F.col("least") == 0)).select("row")
    return clean.unionByName(rest).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
