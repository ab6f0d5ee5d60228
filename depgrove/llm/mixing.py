"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same ratio of target to size.  Its whole part
is taken outright; the fraction is an inclusion probability.  The flight phase
moves those probabilities along the null space of the balancing constraints (sum
of probabilities, sum of probability times size) until at most two documents of a
block stay undecided, and spares a few of all sizes; the rest of all blocks meets
again in fewer blocks.  What the last flight of a source leaves is decided by the
landing so that the token total comes nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgrove.llm.common import checkpointed, word_count

#: Fixed values of the mix: weights by rank of the source, share of all sizes, limit.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: Documents that one task balances at a time; at least twice what a block leaves over.
BLOCK = 4_000
#: Documents of a block that the flight spares; the last ones are decided by the landing.
RESERVE = 14
_EDGE = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``source, docs, source_size, target`` from ``source, size``; one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn.  A source whose
    share exceeds ``limit`` times its size stops there; the others share the excess by
    weight.  With sources ordered by size over weight the stopped ones come first, so
    two running sums give the final level.  The windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(limit)
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    ranked = per.withColumn("weight", weight).withColumn("cap", cap).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    ranked = ranked.withColumn("before_cap", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("before_cap")) / F.col("left_weight"))
    # the first source in this order that stays below its limit fixes the level for all after it; later ones give lower levels
    ranked = ranked.withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return ranked.select("source", "docs", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move ``chance`` to 0 or 1, keeping its sum and its size-weighted sum, until two are left.

    Units are taken in the given order: put large ones first, then small ones land.
    """
    p = chance.tolist()
    s = size.tolist()
    live: list[int] = []
    for unit in range(len(p)):
        if not _EDGE < p[unit] < 1 - _EDGE:
            p[unit] = float(round(p[unit]))
            continue
        live.append(unit)
        if len(live) < 3:
            continue
        a, b, c = live
        # the null space of [[1, 1, 1], [sa, sb, sc]]; equal sizes leave two dimensions, one is enough
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(live, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(live, u, strict=True) if d)
        step = up if draw.random() * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            p[i] += step * d
        rest = []
        for i in live:
            if _EDGE < p[i] < 1 - _EDGE:
                rest.append(i)
            else:
                p[i] = float(round(p[i]))
        live = rest
    return np.array(p, dtype=float)


def reserved(size: np.ndarray, chance: np.ndarray, count: int = RESERVE) -> np.ndarray:
    """Units that the last flight leaves to the landing, spread evenly over the sizes."""
    open_units = np.flatnonzero((chance > _EDGE) & (chance < 1 - _EDGE))
    by_size = open_units[np.argsort(size[open_units], kind="stable")]
    return by_size[np.unique(np.linspace(0, len(by_size) - 1, min(count, len(by_size))).astype(int))] if len(by_size) else by_size


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decide the few units that are left: nearest token total first, then document total."""
    open_units = np.flatnonzero((chance > _EDGE) & (chance < 1 - _EDGE))
    tokens, documents = np.zeros(1), np.zeros(1)
    for unit in open_units:  # totals of all subsets; bit k of the place says whether unit k is taken
        tokens = np.concatenate((tokens, tokens + size[unit]))
        documents = np.concatenate((documents, documents + 1))
    scale = max(float(size[open_units].mean()), 1.0) if len(open_units) else 1.0
    cost = np.abs(tokens - float((size[open_units] * chance[open_units]).sum())) / scale + 0.001 * np.abs(documents - float(chance[open_units].sum()))
    best = int(np.argmin(cost))
    out = np.round(chance)
    out[open_units] = [best >> k & 1 for k in range(len(open_units))]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    Size is the number of words, 0 for null text; ``taken`` is size times the number
    of times the document is taken.  A source of size 0 takes its documents 0 times.
    Null sources form one source, the last.  Blocks are dealt by hash within a source,
    so a large source becomes many blocks.  Order and draws depend on ids and sizes
    only: reruns agree, and repeated rows get the same decisions in some order.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sizes = checkpointed(sizes)
    aim = targets(sizes, weights, share, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aim = checkpointed(aim.withColumn("ratio", F.least(ratio, F.lit(float(limit)))))
    rows = sizes.join(aim, sizes["source"].eqNullSafe(aim["source"])).select(F.col("doc_id").cast("string").alias("doc_id"), sizes["source"], "size", "docs", "source_size", "target", F.floor("ratio").cast("long").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("chance"))
    out = "doc_id string, source string, size long, docs long, source_size long, target double, whole long, chance double, block long"

    def settle(last: bool, level: int):
        def run(unit: pd.DataFrame) -> pd.DataFrame:
            unit = unit.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
            number = int(unit["block"].iloc[0]) if len(unit) else 0
            name = str(unit["source"].iloc[0]).encode()
            draw = np.random.default_rng([seed, level, number, *name])
            size, chance = unit["size"].to_numpy(float), unit["chance"].to_numpy(float, copy=True)
            held = reserved(size, chance)
            flown = np.delete(np.arange(len(size)), held)
            chance[flown] = flight(size[flown], chance[flown], draw)
            if last:
                chance = landing(size, chance)
            return unit.assign(chance=chance)

        return run

    if block < 2 * (RESERVE + 2):
        raise ValueError("a block must be twice as large as what it leaves over")
    done: list[DataFrame] = []
    level, most = 0, aim.agg(F.max("docs")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("docs") / F.lit(block)).cast("long")
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.greatest(blocks, F.lit(1))))
        last = most <= block
        moved = checkpointed(dealt.groupBy("source", "block").applyInPandas(settle(last, level), out))
        if last:
            done.append(moved)
            break
        is_open = (F.col("chance") > _EDGE) & (F.col("chance") < 1 - _EDGE)
        done.append(moved.where(~is_open))
        left = moved.where(is_open).drop("block", "docs")
        counts = checkpointed(left.groupBy("source").agg(F.count(F.lit(1)).alias("docs")))
        rows = left.join(counts.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its").select(*rows.columns)
        level, most = level + 1, counts.agg(F.max("docs")).first()[0] or 0
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", ((F.col("whole") + F.round("chance").cast("long")) * F.col("size")).alias("taken"), (F.col("whole") + F.round("chance").cast("long")).cast("int").alias("copies"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as it is taken.

    Rows that agree in id, source and size share their decisions: the first by content
    gets the largest.  The texts move once, to their decisions.  Columns may have any
    name and any type; an empty table gives none.
    """
    chosen = mix(docs, **parameters)
    # a struct compares null fields as equal, and its partitioning serves the window as well
    decided = chosen.select(F.struct("doc_id", "source", "size").alias("key"), "copies").groupBy("key").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("decided"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    size = F.nullif(word_count(F.col("text").cast("string")), F.lit(-1).cast("long"))  # nullable like the other side, or the join would compare a cast and deal the rows again
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    left = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(F.col("text").cast("string")).alias("said"), F.to_json(F.struct(others.alias("others"))).alias("beside"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("said", "beside"))
    dealt = left.join(decided, "key").withColumn("copies", F.element_at("decided", turn))
    repeated = dealt.where(F.col("copies") > 0).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
