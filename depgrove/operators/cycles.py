"""Cycles without a length limit: strongly connected components and what follows from them.

Nodes with a single way in or out are taken out of the graph, many at a time: their
edges are spliced, so a chain or ring of n nodes is gone after about log n rounds, and
what had been taken out is put back in the opposite order.  Chains go first, whole runs
between nodes drawn to stay, which leaves about a third of them a round.  The dense rest is coloured:
the largest node that reaches a node is its colour, and what a colour's root is reached
from inside the colour is one component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgrove.operators.graph import filtered, reach
from depgrove.session import checkpointed

#: One in so many nodes of a chain is drawn to stay; runs of up to 2 ** DOUBLINGS others between them go at once.
STAYS = 4
DOUBLINGS = 4


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``id, component, size``: the component of every endpoint, named by its least member.

    A node on no cycle is a component of one.  Nulls, repeated edges and loops are
    allowed; edges with a null end are left out.  The driver only asks whether tables
    are empty.
    """
    plain = checkpointed(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    ends = plain.select(F.col("src").alias("id")).unionByName(plain.select(F.col("dst").alias("id"))).distinct()
    rest = plain.where("src != dst")
    taken: list[DataFrame] = []
    labels: list[DataFrame] = []
    while True:
        rest, spliced = _spliced(rest)
        taken += spliced
        if rest.isEmpty():
            break
        found = _coloured(rest)
        done = checkpointed(found.where("root IS NOT NULL").select("id", F.col("root").alias("label")))
        labels.append(done)
        # other components lie inside one colour
        open_ = found.where("root IS NULL").select("id", "colour")
        inside = rest.join(open_.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(open_.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst")
        rest = checkpointed(inside.where("a = b").select("src", "dst"))
    # a component of its own unless told otherwise; only what was told is kept, so a round handles no more than its own graph had
    told = ends.select("id", F.col("id").alias("label")).limit(0)
    for more in labels:
        told = told.unionByName(more)
    for spliced in reversed(taken):
        a = told.select(F.col("id").alias("src"), F.col("label").alias("a"))
        b = told.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        same = spliced.join(a, "src", "left").join(b, "dst", "left").select(F.col("node").alias("id"), F.coalesce("a", "src").alias("label"), F.coalesce("b", "dst").alias("b")).where("label = b")
        told = checkpointed(told.unionByName(same.groupBy("id").agg(F.min("label").alias("label"))))
    known = checkpointed(ends.join(told, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    names = known.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return known.join(names, "label").select("id", "component", "size")


def _spliced(rest: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The graph without nodes that have at most one way in or out; ``src, node, dst`` of what was spliced, by round.

    A node u -> v -> w is in the component of u exactly if w is, once only one of its
    sides has a choice.  Nodes taken in one round are no neighbours: each has the least
    hash among the candidates around it.
    """
    rest, rounds = _shortened(rest)
    turn = 0
    while True:
        turn += 1
        out = rest.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outs"))
        into = rest.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ins"))
        degree = out.join(into, "id", "full").where("coalesce(outs, 0) < 2 OR coalesce(ins, 0) < 2").select("id", (F.col("outs").isNull() | F.col("ins").isNull()).alias("ended"), F.xxhash64("id", F.lit(turn)).alias("h"))
        a, b = (degree.where("NOT ended").select(F.col("id").alias(c), F.col("h").alias(f"h_{c}")) for c in ("src", "dst"))
        loser = F.when(F.struct("h_src", "src") > F.struct("h_dst", "dst"), F.col("src")).otherwise(F.col("dst"))
        beaten = rest.join(a, "src").join(b, "dst").select(loser.alias("id")).distinct()
        gone = checkpointed(degree.select("id", "ended").join(beaten, "id", "left_anti"))
        if gone.isEmpty():
            return rest, rounds
        chosen = gone.where("NOT ended").select("id")
        before = rest.join(chosen.select(F.col("id").alias("dst")), "dst").select("src", F.col("dst").alias("node"))
        after = rest.join(chosen.select(F.col("id").alias("src")), "src").select(F.col("src").alias("node"), "dst")
        spliced = checkpointed(before.join(after, "node").select("src", "node", "dst"))
        rounds.append(spliced)
        # every edge that touches what is gone goes, every spliced one comes; those of ended nodes go with them
        edges = rest.join(chosen.select(F.col("id").alias("src")), "src", "left_anti").join(chosen.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst").unionByName(spliced.where("src != dst").select("src", "dst"))
        ended = gone.where("ended").select("id")
        rest = checkpointed(edges.join(ended.select(F.col("id").alias("src")), "src", "left_anti").join(ended.select(F.col("id").alias("dst")), "dst", "left_anti").distinct())


def _shortened(rest: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The graph without most nodes of its chains, and ``src, node, dst`` of what was spliced, by round.

    Of the nodes with one way in and one out some are drawn to stay; the others lie in
    runs between two nodes that stay.  A node knows what is 1, 2, 4, ... steps before and
    after it, up to the ends of its run, by what its neighbours at that distance tell it:
    one shuffle for each doubling.  Runs that are known to both ends go whole, longer ones
    wait for another draw.  It ends when a round takes less than a quarter of the edges.
    """
    none = F.lit(None).cast(rest.schema["src"].dataType)
    end = lambda at, inner, far: F.struct(at.alias("at"), inner.alias("inner"), far.alias("far"))
    rounds: list[DataFrame] = []
    size = rest.count()
    while size:
        both = F.array(F.struct(F.col("src").alias("id"), none.alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("id"), F.col("src").alias("a"), none.alias("b")))
        nodes = rest.select(F.explode(both).alias("e")).select("e.*").groupBy("id").agg(F.count("a").alias("ins"), F.count("b").alias("outs"), F.min("a").alias("a"), F.min("b").alias("b"))
        inner = nodes.where("ins = 1 AND outs = 1").where(F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(STAYS)) != 0)
        no = F.lit(None).cast("boolean")
        tells = F.array(
            F.struct(F.col("id"), F.col("a"), F.col("b"), no.alias("before"), no.alias("after")),
            F.struct(F.col("a").alias("id"), none.alias("a"), none.alias("b"), no.alias("before"), F.lit(True).alias("after")),
            F.struct(F.col("b").alias("id"), none.alias("a"), none.alias("b"), F.lit(True).alias("before"), no.alias("after")),
        )
        heard = inner.select(F.explode(tells).alias("e")).select("e.*").groupBy("id").agg(*(F.max(c).alias(c) for c in ("a", "b", "before", "after"))).where("a IS NOT NULL")
        runs = heard.select("id", end(F.col("a"), F.coalesce("before", F.lit(False)), F.lit(1)).alias("back"), end(F.col("b"), F.coalesce("after", F.lit(False)), F.lit(1)).alias("ahead"))
        for turn in range(DOUBLINGS):
            back, ahead = F.col("back"), F.col("ahead")
            further = lambda c: end(c["at"], c["inner"], c["far"] + (1 << turn))  # noqa: B023, E731
            empty = F.lit(None).cast(runs.schema["back"].dataType)
            tells = F.array(
                F.struct(F.col("id"), F.when(~back["inner"], back).alias("back"), F.when(~ahead["inner"], ahead).alias("ahead")),
                F.struct(F.when(ahead["inner"], ahead["at"]).alias("id"), further(back).alias("back"), empty.alias("ahead")),
                F.struct(F.when(back["inner"], back["at"]).alias("id"), empty.alias("back"), further(ahead).alias("ahead")),
            )
            runs = runs.select(F.explode(tells).alias("e")).select("e.*").where("id IS NOT NULL").groupBy("id").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead"))
        whole = runs.where(f"NOT back.inner AND NOT ahead.inner AND back.far + ahead.far - 1 <= {1 << DOUBLINGS}")
        spliced = checkpointed(whole.select(F.col("back.at").alias("src"), F.col("id").alias("node"), F.col("ahead.at").alias("dst")))
        taken = spliced.count()
        if not taken:
            break
        rounds.append(spliced)
        gone = spliced.select(F.col("node").alias("src"))
        left = rest.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        rest = checkpointed(left.unionByName(spliced.where("src != dst").select("src", "dst")).distinct())
        if 4 * taken < size:
            break
        size = rest.count()
    return rest, rounds


def _coloured(rest: DataFrame) -> DataFrame:
    """``id, colour, root``: the largest node that reaches each node, and that node itself where the node reaches it."""
    colour = rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct().select("id", F.col("id").alias("colour"))
    changed = colour = checkpointed(colour)
    while True:
        sent = changed.withColumnRenamed("id", "src").join(rest, "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("sent"))
        better = checkpointed(sent.join(colour, "id").where("sent > colour").select("id", F.col("sent").alias("colour")))
        if better.isEmpty():
            break
        colour = checkpointed(colour.join(better.withColumnRenamed("colour", "sent"), "id", "left").select("id", F.coalesce("sent", "colour").alias("colour")))
        changed = better
    a, b = (colour.select(F.col("id").alias(c), F.col("colour").alias(f"c_{c}")) for c in ("src", "dst"))
    inside = checkpointed(rest.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst"))
    roots = colour.where("id = colour").select("id")
    reached = reach(inside, roots, "backward").select("id", F.lit(True).alias("hit"))
    return checkpointed(colour.join(reached, "id", "left").select("id", "colour", F.when(F.col("hit"), F.col("colour")).alias("root")))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle, loops included, with their ``component``."""
    known = strongly_connected(edges)
    a = edges.join(known.select(F.col("id").alias("src"), "component"), "src")
    return a.join(known.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").drop("other").select(*edges.columns, "component")


def traversed(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """The edges that a walk from ``starts(id)`` meets, with ``distance`` of their source and ``relationship``.

    A cyclic-dependency leads back to where its source can be reached from, inside what
    the walk meets; all others are direct-dependency.  Which edge of a cycle closes it
    would depend on the order of a depth-first walk, so all of them count.
    """
    reached = checkpointed(reach(edges, starts, "forward", depth))
    met = reached if depth is None else reached.where(F.col("distance") < depth)
    seen = checkpointed(edges.join(met.select(F.col("id").alias("src"), "distance"), "src"))
    on_cycle = cyclic_edges(seen.select("src", "dst")).select("src", "dst", F.lit(True).alias("on_cycle")).distinct()
    tag = F.when(F.col("on_cycle"), "cyclic-dependency").otherwise("direct-dependency")
    return seen.join(on_cycle, ["src", "dst"], "left").withColumn("relationship", tag).drop("on_cycle")


def crawl_cycles(edges: DataFrame, starts: DataFrame, depth: int | None = None, min_confidence: float = 0.0) -> DataFrame:
    """``component, members, size, kind``: the cycles among what a crawl from several starts reaches.

    ``kind`` is direct where a start is a member or the members have no more parents
    than there are members, else cross_branch: the cycle is entered from several sides.
    """
    kept = checkpointed(filtered(edges, min_confidence).select("src", "dst").distinct())
    reached = checkpointed(reach(kept, starts, "forward", depth))
    inside = kept.join(reached.select(F.col("id").alias("src")), "src", "left_semi").join(reached.select(F.col("id").alias("dst")), "dst", "left_semi")
    looped = inside.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
    members = checkpointed(strongly_connected(inside).join(looped, "id", "left").where("size > 1 OR loop").join(reached, "id"))
    expanded = reached if depth is None else reached.where(F.col("distance") < depth)
    parents = inside.join(expanded.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst"), "component"), "dst")
    counted = parents.groupBy("component").agg(F.countDistinct("src").alias("parents"))
    groups = members.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"), F.max("size").alias("size"), F.min("distance").alias("nearest"))
    kind = F.when((F.col("nearest") > 0) & (F.coalesce("parents", F.lit(0)) > F.col("size")), "cross_branch").otherwise("direct")
    return groups.join(counted, "component", "left").select("component", "members", "size", kind.alias("kind"))
