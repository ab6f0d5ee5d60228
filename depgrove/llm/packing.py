"""Best-fit packing of tokenised documents under several capacities at once.

A bin has residual capacities for tokens, documents and attention cost (the sum of
squared piece lengths).  Each piece, longest first, goes to the open bin that holds
it under every constraint and scores best: largest weighted dot product of residual
and demand, or smallest weighted norm of what would be left.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depgrove.llm.common import checkpointed, kept, text_blocks

LENGTH = 2048
#: Pieces that one task packs at a time.
BLOCK = 12_000
#: The contract's vocabulary, and the same one as ranks for the faster of two public libraries.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SEPARATOR = 0


def encoder(vocabulary: str, ranks: str):
    """A function from text to ids by the byte-level BPE vocabulary with its added tokens, kept per worker.

    Ids equal those that the ``tokenizers`` library with its default settings gives for
    the JSON file (the tests compare both); that library takes five times as long.  An
    added token's string in a text is that token, as it is there.  A text that the
    faster library's pattern cannot split, such as a million blanks, goes to the other.
    """

    def build():
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            added = {token["content"]: token["id"] for token in json.load(f)["added_tokens"]}
        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=added)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:  # its pattern ran out of stack
                return kept_tokenizer().encode(text, add_special_tokens=False).ids

        @functools.cache
        def kept_tokenizer():
            return tokenizers.Tokenizer.from_file(vocabulary)

        return encode

    return kept(f"tokenizer {vocabulary} {ranks}", build)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document.

    A document is the ids of its whole text (null: empty) and one separator id.  One
    longer than ``length`` is cut into pieces of that length, the remainder first.
    """
    paths = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = to_arrow_schema(T._parse_datatype_string(PIECE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch, texts in text_blocks(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.array([*encode(text.decode("utf-8", "replace")), SEPARATOR], dtype="<u4")
                at, number, n = 0, 0, len(ids)
                upto = n % length or min(n, length)
                while at < n:
                    out.append((doc_id, number, at, upto - at, zlib.crc32(ids[at:upto].tobytes())))
                    at, number, upto = upto, number + 1, upto + length
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, PIECE)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of every row of ``demand`` (pieces by dimensions), rows taken in the given order.

    A row that fits no empty bin gets one for itself.
    """
    n, dims = demand.shape
    share = demand / capacity
    left = np.empty((dims, max(n, 1)))
    label = np.empty(max(n, 1), dtype=np.int64)
    smallest = share[:, 0].min() if n else 0.0
    out = np.empty(n, dtype=np.int64)
    used = opened = 0
    for i in range(n):
        d = share[i]
        fits = left[0, :opened] >= d[0] - 1e-12
        for k in range(1, dims):
            fits &= left[k, :opened] >= d[k] - 1e-12
        at = np.flatnonzero(fits)
        if len(at):
            if rule == "dot":
                score = sum(weights[k] * d[k] * left[k, at] for k in range(dims))
                best = at[np.argmax(score)]
            else:
                score = sum(weights[k] * (left[k, at] - d[k]) ** 2 for k in range(dims))
                best = at[np.argmin(score)]
        else:
            best = opened
            left[:, best], label[best] = 1.0, used
            opened, used = opened + 1, used + 1
        left[:, best] -= d
        out[i] = label[best]
        if left[0, best] < smallest - 1e-12:  # full: the last open bin takes its place
            opened -= 1
            left[:, best], label[best] = left[:, opened], label[opened]
    return out


#: Registered uses: document and attention-cost capacities (implied by the tokens, so they never bind) and weights of the three residuals.
REGISTERED = {"max_documents": LENGTH, "max_cost": float(LENGTH * LENGTH), "weights": (1.0, 0.5, 0.5)}
PACKED = PIECE + ", sequence_id long, offset long"


def pack(cut: DataFrame, length: int = LENGTH, max_documents: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """Place pieces (``doc_id, piece, start, length, ids_crc32``) in sequences.

    Pieces of full length are sequences by themselves.  The others are dealt by hash
    to blocks of about ``block`` pieces, each packed longest first; only a block's last
    bins stay open, a few in thousands.  ``max_documents`` and ``max_cost`` (sum of
    squared lengths) bound every sequence as well; None leaves that dimension free.
    Null ids are documents of their own; an empty table gives an empty result.
    """
    cut = checkpointed(cut)
    free = float(1 << 40)
    capacity = np.array([float(length), float(max_documents or free), float(max_cost or free)])
    scale = np.array(weights, dtype=float)
    small = cut.where(F.col("length") < length)
    blocks = max(1, -(-small.count() // block))

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        tokens = unit["length"].to_numpy(float)
        demand = np.stack([tokens, np.ones(len(tokens)), tokens**2], axis=1)
        unit = unit.assign(bin=best_fit(demand, capacity, scale, rule)).sort_values("bin", kind="stable")
        unit["offset"] = unit.groupby("bin")["length"].cumsum() - unit["length"]
        unit["sequence_id"] = unit["bin"] * blocks + unit["block"]
        return unit[[f.split()[0] for f in PACKED.split(", ")]]

    dealt = small.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("block").applyInPandas(run, PACKED.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    # negative numbers for sequences that one whole piece fills, so both kinds stay apart
    whole = cut.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)
