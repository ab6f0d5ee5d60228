"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words with their counts as weights.  For sample d a term k of
weight S draws, from hashes of (k, d) alone, r and c from Gamma(2, 1) and b from
U(0, 1); with t = floor(ln S / r + b) its value is c exp(-r (t - b + 1)), and the least
value over all terms is the sample.  The value depends on (k, t) only, so two
documents agree in a sample with the probability of their generalised Jaccard
similarity, sum of minima over sum of maxima of the weights.

A product of a Gamma(2, 1) and an independent uniform is exponential, and so is what is
left of the Gamma, independently.  So a and a' are drawn with c = a + a' and
exp(-r (1 - b)) = q = a / c, and p with exp(-r b) = p.  The value is a (p q)^t, compared as
u^((p q)^t) with u = exp(-a), largest first; t is 0 where S q < 1, as for all single words,
whose value is the uniform u itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgrove.llm.common import checkpointed

SAMPLES = 64
SPLIT = r"[\x20\x09-\x0D]+"
#: Ids of one block and blocks of one superblock when the next id is looked up.
SPAN = 4096


def term_counts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, term, weight``: hashes of a text's words with their counts; one null term for a text without words."""
    hashes = F.array_remove(F.transform(F.split(F.col(text), SPLIT), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    return texts.select(*keys, F.explode_outer(hashes).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("weight"))


def sample_value(term: Column, weight: Column, log_weight: Column, number: int) -> Column:
    """The term's value in sample ``number``, null for a null weight; the largest counts."""
    h, g = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))
    uniform = lambda bits, size: (bits.cast("double") + 0.5) / float(size)
    u = uniform(F.shiftrightunsigned(h, 12), 1 << 52)
    a, rest = -F.log(u), -F.log(uniform(F.shiftrightunsigned(g, 32), 1 << 32))
    p, q = uniform(g.bitwiseAND(F.lit((1 << 32) - 1)), 1 << 32), a / (a + rest)
    step = F.log(p * q)
    further = F.exp(-a * F.exp(F.floor((F.log(p) - log_weight) / step) * step))
    return F.when(weight <= 1.0, u).when(weight > 1.0, F.when(weight * a >= a + rest, further).otherwise(u))


def sketches(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``sketch`` (array of ``samples`` ints, empty for a text without words).

    ``texts`` has one row for each key.  Where it is partitioned by a key already,
    nothing is shuffled; the counts of a word never leave the task that read the text.
    """
    # xxhash64 passes over nulls, so the null term of a text without words would draw values too
    weight = F.when(F.col("term").isNotNull(), F.col("weight").cast("double"))
    rows = term_counts(texts, keys, text).select(*keys, "term", weight.alias("weight"), F.log(weight).alias("log_weight"))
    best = rows.groupBy(*keys).agg(*[F.max(sample_value(F.col("term"), F.col("weight"), F.col("log_weight"), d)).alias(f"s{d}") for d in range(samples)])
    folded = [F.shiftright(F.xxhash64(f"s{d}"), 32).cast("int") for d in range(samples)]
    return best.select(*keys, F.when(F.col("s0").isNull(), F.array().cast("array<int>")).otherwise(F.array(*folded)).alias("sketch"))


def to_text(sketch: Column) -> Column:
    """The fingerprint: eight hex digits for each sample."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two sketches agree; two empty ones are alike, an empty one is like no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(same / F.greatest(F.size(a), F.lit(1)))


def previous_ids(ids: DataFrame) -> DataFrame:
    """``key, prev_key`` of distinct keys, in a ring by ascending key.

    Ids are dealt to blocks by value and blocks to superblocks; a block's last id looks
    up the next block's first, so no window but that over superblocks (one row for
    SPAN * SPAN ids of range) meets in one task.
    """
    blocks = ids.groupBy(F.floor(F.col("key") / SPAN).cast("long").alias("block")).agg(F.min("key").alias("low"))
    supers = blocks.groupBy(F.floor(F.col("block") / SPAN).cast("long").alias("super")).agg(F.min("low").alias("super_low"))
    supers = supers.select("super", F.lead("super_low").over(Window.orderBy("super")).alias("super_next"), F.min("super_low").over(Window.partitionBy()).alias("ring"))
    blocks = blocks.withColumn("super", F.floor(F.col("block") / SPAN).cast("long")).withColumn("block_next", F.lead("low").over(Window.partitionBy("super").orderBy("block")))
    blocks = blocks.join(supers, "super").select("block", F.coalesce("block_next", "super_next", "ring").alias("after"))
    own = ids.withColumn("block", F.floor(F.col("key") / SPAN).cast("long")).withColumn("lead", F.lead("key").over(Window.partitionBy("block").orderBy("key")))
    return own.join(blocks, "block").select(F.coalesce("lead", "after").alias("key"), F.col("key").alias("prev_key"))


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` for every row.  The edited text has its last
    floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document by doc_id; after the last comes the first.  Null text counts as empty, a
    null doc_id as smaller than all others; of rows that share an id the one with the
    least text hash is what the document before looks at.  A text without words has an
    empty fingerprint.  Equal texts have equal fingerprints; an empty table gives none.

    A text is shuffled once, by key and text hash, and all that is joined with it by the
    same two; only its head, then its sketch, go to the document before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").isNull().alias("unnamed"), text.alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    # equal rows of one id count once here and come back at the end
    ids = checkpointed(rows.groupBy("key", "rid").agg(F.max(half).alias("half"), F.count(F.lit(1)).alias("copies"), F.count_if("unnamed").alias("nulls")))
    heard = ids.groupBy("key").agg(F.min("rid").alias("rid"))
    ring = checkpointed(heard.join(previous_ids(heard.select("key")), "key"))
    once = rows.select("key", "rid", "text").repartition("key", "rid").groupBy("key", "rid").agg(F.first("text").alias("text"))
    asked = ring.join(ids.select(F.col("key").alias("prev_key"), F.col("rid").alias("prev_rid"), F.col("half").alias("prev_half")), "prev_key")
    heads = once.join(asked, ["key", "rid"]).select(F.col("prev_key").alias("key"), F.col("prev_rid").alias("rid"), F.substr("text", F.lit(1), "prev_half").alias("head"))
    both = once.join(heads, ["key", "rid"]).withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), "head"))
    kinds = both.select("key", "rid", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"))
    sketched = sketches(kinds.select("key", "rid", "x.which", "x.text"), ["key", "rid", "which"], samples=samples)
    drawn = sketched.groupBy("key", "rid").agg(*[F.max(F.when(F.col("which") == w, F.col("sketch"))).alias(name) for w, name in ((0, "own"), (1, "changed"))])
    facts = both.select("key", "rid", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    known = facts.join(drawn, ["key", "rid"]).join(ids.select("key", "rid", "copies", "nulls"), ["key", "rid"]).join(ring, ["key", "rid"], "left")
    # a row stays at its key, and the sketch that the document before looks at goes there
    twice = known.withColumn("sent", F.explode(F.array(F.lit(False), F.lit(True)))).where("NOT sent OR prev_key IS NOT NULL")
    stays = ["n_chars", "edited_sha256", "changed", "copies", "nulls"]
    placed = twice.select(
        "sent", F.when(F.col("sent"), F.col("prev_key")).otherwise(F.col("key")).alias("key"), "own", *[F.when(~F.col("sent"), F.col(c)).alias(c) for c in stays]
    )
    following = F.max(F.when(F.col("sent"), F.col("own"))).over(Window.partitionBy("key"))
    out = placed.withColumn("following", following).where("NOT sent").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        F.when(F.col("copy") > F.col("nulls"), F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", to_text(F.col("own")).alias("fingerprint"), to_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
