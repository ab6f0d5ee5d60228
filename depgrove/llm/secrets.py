"""Secret scans with a linear-chain conditional random field.

Fixed patterns find the base spans.  A field over the tokens (words) of a text with
the tags outside, begin and inside is fitted on a bounded sample; its features are the
token's shape, the neighbouring words and the file.  The labels are the base spans, and
a second copy of each text teaches what the patterns miss: there every base span gives
way to a value of another shape behind another announcing word or none, next to a
harmless token that looks similar (an address, a path, a version, a long number).
Viterbi decoding of every whole text adds spans where the patterns see nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgrove.llm.common import Words, checkpointed, text_blocks

#: Fixed patterns and the least length of what must be long: group 2 or the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "crf")
#: The documented bound of the sample that the field is fitted on: documents with a
#: base span and without, and the tokens of a training window on either side of its centre.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 20_000
AROUND = 15
#: Words that announce a value.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "bearer", "authorization", "credential", "credentials", "auth")
TAGS = ("outside", "begin", "inside")
#: What stands before a value in a disguised copy; no pattern knows it.
ANNOUNCED = ("credential", "credentials:", "auth", "auth =", "Authorization: Bearer", "bearer", "key", "key =", "private key:", "signature", "signed with", "use", "")
LETTERS = string.ascii_letters + string.digits

_assign = re.compile(ASSIGN, re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run shorter than 20 holds no longer match
_hex = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as above
_hints = (b"passw", b"secret", b"token", b"api")


def base_spans(text: str, lowered: bytes | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind in the order of KINDS."""
    lowered = text.encode("utf-8", "surrogatepass").lower() if lowered is None else lowered
    out = []
    if any(h in lowered for h in _hints):
        out += [(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _access.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in _hex.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_keyword_hashes: list[np.ndarray] = []


def _keywords() -> np.ndarray:
    if not _keyword_hashes:
        forms = [w + tail for w in KEYWORDS for tail in ("", ":", "=", '":', "':", ",", ".")]
        _keyword_hashes.append(np.unique(Words([f.encode() for f in forms]).hash))
    return _keyword_hashes[0]


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(characters, dtype=np.uint8)] = True
    return out


_DIGIT, _UPPER, _LOWER = _mask(b"0123456789"), _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123)))
_EQUALS, _COLON, _JOIN, _HEXDIGIT = _mask(b"="), _mask(b":"), _mask(b"_-/+"), _mask(b"0123456789abcdef")
_QUOTE = _mask(b"\"'`")
_STOP = _mask(b".,;:!?")
_AT, _PATH = _mask(b"@"), _mask(b"./")
#: 1 for digits, 2 for small letters, 3 for capitals, 0 for all else
_CLASS = (_DIGIT + 2 * _LOWER.astype(np.int8) + 3 * _UPPER.astype(np.int8)).astype(np.int8)


class Features:
    """Feature rows of all tokens of a block of texts, and which tokens could be more than outside."""

    names = (
        "bias", "length>=8", "length>=16", "length>=20", "length>=32", "digit", "digits>1/5", "upper", "lower", "letters and digits",
        "equals", "colon", "joined", "hexadecimal", "quote", "keyword", "before: keyword", "before: equals or colon", "before: letters and digits",
        "after: letters and digits", "after: keyword", "file: tokens with digits", "file: assignments", "file: long",
        "at sign", "dot or slash inside", "classes change 4 times", "classes change 8 times", "classes change 4 times, no at sign or dot", "only digits and signs",
    )

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts, lower=True)
        raw = np.frombuffer(words.data, dtype=np.uint8)
        start, end = words.start, words.end

        def within(marks: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(raw) + 1, dtype=np.int32)
            np.cumsum(marks, out=sums[1:])
            return sums[end] - sums[start]

        def count(mask: np.ndarray) -> np.ndarray:
            return within(mask[raw])

        size = end - start
        digits, upper, lower = count(_DIGIT), count(_UPPER), count(_LOWER)
        equals, colon, joined = count(_EQUALS) > 0, count(_COLON) > 0, count(_JOIN) > 0
        mixed = (digits > 0) & (upper + lower > 0)
        last = raw[end - 1] if len(end) else raw[:0]
        keyword = np.zeros(len(start), dtype=bool)
        some = np.flatnonzero((size >= 3) & (size <= 18) & (digits == 0))
        keyword[some] = np.isin(words.hash[some], _keywords())
        owner = words.owners()
        begins, finishes = np.ones(len(start), bool), np.ones(len(start), bool)
        begins[1:] = owner[1:] != owner[:-1]
        finishes[:-1] = begins[1:]

        def before(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), dtype=bool)
            out[1:] = x[:-1]
            return out & ~begins

        def after(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), dtype=bool)
            out[:-1] = x[1:]
            return out & ~finishes

        n = np.maximum(np.diff(words.first), 1)

        def share(x: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=x, minlength=len(texts)) / n

        kind = _CLASS[raw]
        change = np.zeros(len(raw), dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        changes, at_sign, path = within(change), count(_AT) > 0, count(_PATH) - (_PATH[last] if len(last) else 0) > 0
        sign = equals | (colon & (last == ord(":")))
        self.columns = (
            np.ones(len(start), bool), size >= 8, size >= 16, size >= 20, size >= 32, digits > 0, 5 * digits > size, upper > 0, lower > 0, mixed,
            equals, colon, joined, (size >= 8) & (count(_HEXDIGIT) + count(_QUOTE) + _STOP[last] >= size) & (digits > 0), count(_QUOTE) > 0, keyword, before(keyword), before(sign), before(mixed),
            after(mixed), after(keyword), (share(digits > 0) > 0.05)[owner], (share(equals) > 0.01)[owner], (n > 1000)[owner],
            at_sign, path, changes >= 4, changes >= 8, (changes >= 4) & ~at_sign & ~path, (digits > 0) & (upper + lower == 0),
        )

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Emission scores, tokens by tags."""
        out = np.zeros((len(self.words.start), 3), dtype=np.float32)
        for column, row in zip(self.columns, weights.astype(np.float32), strict=True):
            at = np.flatnonzero(column)
            if len(at) == len(out):
                out += row
            else:
                out[at] += row
        return out

    def matrix(self) -> np.ndarray:
        return np.stack(self.columns, axis=1).astype(float)


def viterbi(scores: np.ndarray, move: np.ndarray, start: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
    """Best tags of one sequence; ``before`` and ``after`` are tags fixed on either side."""
    best = scores[0] + (start if before is None else move[before])
    back = []
    for row in scores[1:]:
        through = best[:, None] + move
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    if after is not None:
        best = best + move[:, after]
    tags = [int(best.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return np.array(tags[::-1])


class Field:
    """Weights by feature and tag, transitions by tag and tag, and the first tag's scores."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.weights, self.move, self.start = weights, move, start
        #: by tag: what its two transitions can gain over those of outside, at most
        into = np.maximum((move - move[:, :1]).max(axis=0), start - start[0])
        out_of = np.maximum((move - move[:1]).max(axis=1), 0.0)
        self.gain = into + out_of + 1e-3

    def decode(self, features: Features) -> np.ndarray:
        """The best tag of every token, each text a sequence of its own.

        A token whose lead for outside exceeds what its two transitions can win back is
        outside on every best path, so only the runs between such tokens are searched.
        """
        scores = features.scores(self.weights)
        tags = np.zeros(len(scores), dtype=np.int8)
        unsure = (scores[:, 0] - scores[:, 1] <= self.gain[1]) | (scores[:, 0] - scores[:, 2] <= self.gain[2])
        at = np.flatnonzero(unsure)
        if not len(at):
            return tags
        owner = np.searchsorted(features.words.first, at, side="right") - 1
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0)) + 1
        for run in np.split(at, breaks):
            text = int(np.searchsorted(features.words.first, run[0], side="right")) - 1
            head = run[0] == features.words.first[text]
            tail = run[-1] + 1 == features.words.first[text + 1]
            tags[run] = viterbi(scores[run].astype(float), self.move, self.start, None if head else 0, None if tail else 0)
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(windows: np.ndarray, tags: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; ``windows`` is sequences by tokens by features, ``tags`` their labels."""
    n, length, k = windows.shape
    shapes = [(k, 3), (3, 3), (3,)]
    theta = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    observed = np.eye(3)[tags]
    pairs = np.einsum("nti,ntj->ij", observed[:, :-1], observed[:, 1:])
    for step in range(1, steps + 1):
        weights, move, start = theta
        e = windows @ weights
        alpha, beta = np.empty((length, n, 3)), np.zeros((length, n, 3))
        alpha[0] = start + e[:, 0]
        for t in range(1, length):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + move, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[t] = _log_sum(move[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        single = np.exp(alpha + beta - total[:, None]).transpose(1, 0, 2)
        expected = np.zeros((3, 3))
        for t in range(1, length):
            expected += np.exp(alpha[t - 1][:, :, None] + move + (e[:, t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        gradient = [
            np.einsum("ntk,nti->ki", windows, observed - single) / n - decay * weights,
            (pairs - expected) / n - decay * move,
            (observed[:, 0] - single[:, 0]).sum(axis=0) / n - decay * start,
        ]
        for i, g in enumerate(gradient):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*theta)


def _token_places(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places to code points."""
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    sums = np.concatenate(([0], np.cumsum(lead)))
    return sums[start], sums[end]


def _value(draw: random.Random) -> str:
    """A random value of a shape that no base pattern finds."""
    some = lambda letters, low, high: "".join(draw.choices(letters, k=draw.randint(low, high)))
    kind = draw.randrange(4)
    if kind == 0:
        return some(LETTERS, 20, 44)
    if kind == 1:
        return some(LETTERS + "-_", 24, 48)
    if kind == 2:
        return some(string.ascii_uppercase + string.digits, 20, 32)
    return some(string.ascii_lowercase, 2, 4) + draw.choice("_-") + some(LETTERS, 20, 40)


def _harmless(draw: random.Random) -> str:
    """A token that is no secret but has digits, signs or length."""
    word = lambda low, high: "".join(draw.choices(string.ascii_lowercase, k=draw.randint(low, high)))
    digits = lambda low, high: "".join(draw.choices(string.digits, k=draw.randint(low, high)))
    kind = draw.randrange(7)
    if kind == 0:
        return f"{word(3, 9)}.{digits(1, 3)}@{word(3, 6)}{digits(1, 1)}.{word(5, 8)}.com"
    if kind == 1:
        return f"https://{word(3, 9)}.example.org/{word(3, 8)}/{digits(1, 6)}?{word(2, 4)}={word(3, 8)}"
    if kind == 2:
        return f"/{word(3, 6)}/{word(3, 8)}{digits(0, 2)}/{word(4, 12)}.{word(2, 3)}"
    if kind == 3:
        return f"{word(3, 8)}-v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}"
    if kind == 4:
        return digits(8, 20)
    if kind == 5:
        return "".join(word(3, 8).capitalize() for _ in range(draw.randint(2, 4)))
    return f"{word(4, 14)}_{word(4, 10)}{digits(0, 4)}"


def disguised(text: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """A copy whose base spans are other values behind other words, the places of these values and of a harmless token after each.

    What is drawn follows from the text alone.
    """
    draw = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    out, size, at, values, others = [], 0, 0, [], []

    def put(piece: str) -> int:
        nonlocal size
        out.append(piece)
        size += len(piece)
        return size

    for a, _, b in base_spans(text):
        if a < at:  # a span inside the one before
            continue
        put(text[at:a])
        announced, quote = draw.choice(ANNOUNCED), draw.choice(("", "", '"'))
        begin = put(f" {announced} ")
        values.append((begin, put(quote + _value(draw) + quote)))
        put(" ")
        others.append(put(draw.choice(("", "see ", "key ", "at "))))
        put(_harmless(draw) + " ")
        at = b
        while at < len(text) and not text[at].isspace():  # what hangs on the old value goes with it
            at += 1
    put(text[at:])
    return "".join(out), values, others


def training_set(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows around tokens of base spans, around every 40th token and around the values and harmless tokens of the disguised copy, with their tags."""
    blocks, labels = [], []
    length = 2 * AROUND + 1

    def teach(text: str, spans: list[tuple[int, int]], others: list[int], every: bool) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        features = Features([raw])
        words = features.words
        n = len(words.start)
        if n < length:
            return
        begin, end = _token_places(raw, words.start, words.end)
        tags = np.zeros(n, dtype=np.int64)
        for a, b in spans:
            inside = np.flatnonzero((begin < b) & (end > a))
            fresh = inside[tags[inside] == 0]
            tags[fresh] = 2
            if len(fresh) and fresh[0] == inside[0]:
                tags[fresh[0]] = 1
        matrix = features.matrix()
        near = np.searchsorted(end, np.array(others, dtype=np.int64), side="right")
        for centre in sorted({*np.flatnonzero(tags == 1).tolist(), *near.tolist(), *(range(AROUND, n, 40) if every else ())}):
            low = min(max(centre - AROUND, 0), n - length)
            blocks.append(matrix[low : low + length])
            labels.append(tags[low : low + length])

    for text in texts:
        base = base_spans(text)
        teach(text, [(a, b) for a, _, b in base], [], True)
        if base:
            teach(*disguised(text), False)
    if not blocks:
        return np.zeros((0, length, len(Features.names))), np.zeros((0, length), dtype=np.int64)
    return np.stack(blocks), np.stack(labels)


def learn(docs: DataFrame, most: int = SAMPLE_DOCS) -> Field | None:
    """Fit a field on ``most`` different texts with base spans and as many without, in the order of a hash.

    Documents longer than SAMPLE_CHARS do not teach.  None without anything to learn from.
    Hashes are chosen first (a task hands on ``most`` of them), then their texts are read.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).withColumn("hash", F.xxhash64("text"))
    found = F.rlike("text", F.lit(rf"{ASSIGN}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"))
    hashes = checkpointed(rows.select("hash", found.alias("found")).distinct())
    chosen = {r["hash"]: (r["found"], r["hash"]) for kind in (False, True) for r in hashes.where(F.col("found") == kind).orderBy("hash").limit(most).collect()}
    if not chosen:
        return None
    held = rows.where(F.col("hash").isin(list(chosen))).groupBy("hash").agg(F.min("text").alias("text")).collect()
    windows, tags = training_set([r["text"] for r in sorted(held, key=lambda r: chosen[r["hash"]])])
    return fit(windows, tags) if (tags > 0).any() else None


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf`` of every row.

    Spans are ``kind:start:end`` in code points of the whole text, end exclusive.  The
    field's spans are runs of tagged tokens that overlap no base span; without a field
    there are none.  Null text counts as empty; equal rows get equal results; an empty
    table gives none; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(field)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    schema = pa.schema([(f.split()[0], t) for f, t in zip(RESULT.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            more = _tagged(texts, given.value) if given.value else {}
            out = []
            for i, (doc_id, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
                base = base_spans(raw.decode("utf-8", "replace"), raw.lower())
                extra = [(a, "crf", b) for a, b in more.get(i, ()) if not any(a < y and b > x for x, _, y in base)]
                count = [sum(kind == k for _, kind, _ in base) for k in KINDS[:3]]
                every = sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[1])))
                out.append((doc_id, *count, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(extra)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, RESULT)


def _tagged(texts: list[bytes], field: Field) -> dict[int, list[tuple[int, int]]]:
    """Runs of tagged tokens by text, in code points: begin starts one, inside goes on with it."""
    features = Features(texts)
    tags = field.decode(features)
    at = np.flatnonzero(tags)
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(at):
        return out
    words = features.words
    owner = np.searchsorted(words.first, at, side="right") - 1
    offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    for i in np.unique(owner):
        mine = at[owner == i]
        begin, end = _token_places(texts[i], words.start[mine] - offset[i], words.end[mine] - offset[i])
        runs: list[tuple[int, int]] = []
        for k, token in enumerate(mine):
            if k and tags[token] == 2 and mine[k - 1] == token - 1:
                runs[-1] = (runs[-1][0], int(end[k]))
            else:
                runs.append((int(begin[k]), int(end[k])))
        out[int(i)] = runs
    return out
