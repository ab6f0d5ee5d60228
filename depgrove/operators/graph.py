"""Graph operators on ``nodes(id, ...)`` and ``edges(src, dst, type, confidence, ...)``.

Frontier loops join the frontier with the edges and drop what has been seen; the
driver only counts the frontier.  Each level is written, so lineage stays short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgrove.functions.evidence import check_source_type, noisy_or, source_passes, tier
from depgrove.session import checkpointed

#: Depth that stands for no limit in crawls.
MOST_DEPTH = 100
#: Levels that a reach without a limit walks one by one before it shortens what is left.
LEVELS = 12
#: Rows up to which a mapping may go to every task whole.
BROADCAST = 200_000


def filtered(edges: DataFrame, min_confidence: float = 0.0, source_type: str | None = None) -> DataFrame:
    check_source_type(source_type)
    out = edges.where(F.col("confidence") >= min_confidence)
    return out.where(source_passes(F.col("source_type"), source_type)) if source_type else out


def _steps(direction: str) -> list[tuple[str, str]]:
    return {"forward": [("src", "dst")], "backward": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]


def reach(edges: DataFrame, starts: DataFrame, direction: str = "forward", depth: int | None = None) -> DataFrame:
    """``id, distance`` of everything reachable from ``starts(id)``, the starts at 0.

    ``direction`` is forward, backward or both; ``depth`` None means no limit.  A reach
    without a limit that goes on after ``LEVELS`` levels shortens the chains and trees of the
    rest, so a chain of n nodes costs about log n rounds.
    """
    if depth is None or depth > 1:
        edges = checkpointed(edges.select("src", "dst"))  # made once, read at every level in every direction
    hops = reduce(DataFrame.unionByName, [edges.select(F.col(a).alias("id"), F.col(b).alias("next")) for a, b in _steps(direction)])
    seen = starts.select("id").distinct().withColumn("distance", F.lit(0))
    frontier, level = seen, 0
    while depth is None or level < depth:
        if depth is None and level == LEVELS:
            done = seen.join(frontier.select("id"), "id", "left_anti").select("id")
            ahead = hops.join(seen.select(F.col("id").alias("next")), "next", "left_anti").join(done, "id", "left_anti")
            return seen.unionByName(_reached_far(checkpointed(ahead.select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit(1).alias("w")).distinct()), frontier))
        level += 1
        found = frontier.join(hops, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = checkpointed(found.withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _reached_far(rest: DataFrame, starts: DataFrame) -> DataFrame:
    """``id, distance`` of what ``rest(src, dst, w)`` leads to from ``starts(id, distance)``, themselves left out; no edge leads into a start.

    A node with one way in hangs on the node it comes from.  Such trees are climbed by
    doubling, so one of n levels takes log n rounds, and the ways out of their nodes go
    out of what they hang on, with the weights added up.  What has several ways in is
    walked by levels of better distances; then the trees get theirs, last ones first.
    """
    rounds = []
    while True:
        into = rest.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("up"), F.min("w").alias("w"))
        into = checkpointed(into)
        single, live = into.where("ins = 1"), starts.select("id").unionByName(into.where("ins > 1").select("id"))
        if single.isEmpty():
            break
        tree = checkpointed(single.select("id", "up", "w").join(single.select(F.col("id").alias("up"), F.lit(True).alias("open")), "up", "left").select("id", "up", "w", "open"))
        left = tree.where("open").count()
        while left:
            over = tree.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("w").alias("more"), F.col("open").alias("on"))
            climbed = tree.where("open").join(over, "up").select("id", F.col("top").alias("up"), (F.col("w") + F.col("more")).alias("w"), F.col("on").alias("open"))
            tree = checkpointed(tree.where("open IS NULL").unionByName(climbed))
            before, left = left, tree.where("open").count()
            if left == before:  # they hang on a ring that nothing leads into
                break
        hung = tree.where("open IS NULL").select("id", "up", "w")
        rounds.append(hung)
        rest = rest.join(single.select(F.col("id").alias("dst")), "dst", "left_anti").join(hung.select(F.col("id").alias("src"), "up", F.col("w").alias("more")), "src", "left")
        moved = rest.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")).where("src != dst")
        rest = checkpointed(moved.join(live.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("src", "dst").agg(F.min("w").alias("w")))
    changed = known = starts.select("id", "distance")
    while not rest.isEmpty():
        sent = changed.withColumnRenamed("id", "src").join(rest, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("sent"))
        changed = checkpointed(sent.join(known, "id", "left").where("distance IS NULL OR sent < distance").select("id", F.col("sent").alias("distance")))
        if changed.isEmpty():
            break
        known = checkpointed(known.unionByName(changed).groupBy("id").agg(F.min("distance").alias("distance")))
    for hung in reversed(rounds):
        back = hung.join(known.withColumnRenamed("id", "up"), "up").select("id", (F.col("distance") + F.col("w")).alias("distance"))
        known = known.unionByName(checkpointed(back))
    return known.join(starts.select("id"), "id", "left_anti")


def discovered(edges: DataFrame, reached: DataFrame, direction: str = "forward") -> DataFrame:
    """One edge per reached node: the least (other end, type) that leads from one level to the next."""
    near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
    before = reached.select(F.col("id").alias(near), (F.col("distance") + 1).alias("distance"))
    after = reached.select(F.col("id").alias(far), "distance")
    steps = edges.join(before, near).join(after, [far, "distance"])
    order = Window.partitionBy(far).orderBy(near, "type")
    return steps.withColumn("at", F.row_number().over(order)).where("at = 1").select(F.col(far).alias("id"), "distance", F.col(near).alias("via"), "type", "confidence", tier(F.col("confidence")).alias("confidence_tier"))


def impact(edges: DataFrame, component, depth: int | None = 1, min_confidence: float = 0.0, source_type: str | None = None) -> DataFrame:
    """What depends on a component: reverse reach with distance and the tier of the discovering edge."""
    return _walk(edges, component, "backward", depth, min_confidence, source_type)


def dependencies(edges: DataFrame, component, depth: int | None = 1, min_confidence: float = 0.0, source_type: str | None = None) -> DataFrame:
    """What a component depends on: the mirror image of ``impact``."""
    return _walk(edges, component, "forward", depth, min_confidence, source_type)


def _walk(edges: DataFrame, component, direction: str, depth: int | None, min_confidence: float, source_type: str | None) -> DataFrame:
    kept = checkpointed(filtered(edges, min_confidence, source_type).select("src", "dst", "type", "confidence"))  # read at every level
    start = edges.sparkSession.createDataFrame([(component,)], "id string").select(F.col("id").cast(edges.schema["src"].dataType))
    return discovered(kept, reach(kept, start, direction, depth), direction)


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst`` of every pair connected by a path, by doubling path lengths to a fixpoint."""
    known = checkpointed(edges.select("src", "dst").distinct())
    size = known.count()
    while True:
        longer = known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        known = checkpointed(known.unionByName(longer).distinct())
        now = known.count()
        if now == size:
            return known
        size = now


def simple_paths(edges: DataFrame, max_hops: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """``path, hops, confidence``: all paths without a repeated node, up to ``max_hops`` edges.

    ``start`` and ``end`` are predicates on ``src`` and ``dst``.  The confidence is the
    product over the hops; of parallel edges the best counts.
    """
    best = edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).where("src != dst")
    level = (best.where(start) if start is not None else best).select(F.array("src", "dst").alias("path"), F.lit(1).alias("hops"), "confidence")
    levels = [level]
    step = best.select("src", "dst", F.col("confidence").alias("more"))
    for hops in range(2, max_hops + 1):
        level = level.join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        level = level.select(F.concat("path", F.array("dst")).alias("path"), F.lit(hops).alias("hops"), (F.col("confidence") * F.col("more")).alias("confidence"))
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels).withColumn("dst", F.element_at("path", -1))
    return (found.where(end) if end is not None else found).drop("dst")


def k_shortest(edges: DataFrame, source, target, k: int, max_hops: int | None = None) -> DataFrame:
    """``path, hops, confidence, route, rank``: the k shortest simple paths by hops, ties by the path's text.

    Levels of a backward search give every node its distance to the target.  A path that
    is begun can end no earlier than after its hops and that distance, its length at
    least; paths are continued in the order of that bound, and those that would be longer
    wait.  A length is finished before the next is begun, so the search ends with the
    first length that completes k paths, or when no path waits.  No path leads from a
    node to itself.
    """
    best = checkpointed(edges.groupBy("src", "dst").agg(F.max("confidence").alias("more")).where("src != dst"))
    start = edges.sparkSession.createDataFrame([(target,)], "id string").select(F.col("id").cast(edges.schema["src"].dataType))
    ahead = checkpointed(reach(best, start, "backward", max_hops))
    steps = checkpointed(best.join(ahead.select(F.col("id").alias("dst"), F.col("distance").alias("left")), "dst"))
    kind = edges.schema["src"].dataType
    begun = ahead.where((F.col("id") == F.lit(source)) & (F.lit(source) != F.lit(target))).select(F.array("id").cast(f"array<{kind.simpleString()}>").alias("path"), F.lit(0).alias("hops"), F.lit(1.0).alias("confidence"), F.col("distance").alias("bound"))
    waiting, done, length, found = [checkpointed(begun)], [], None, 0
    while True:
        least = reduce(DataFrame.unionByName, waiting).agg(F.min("bound")).first()[0]
        if found >= k or least is None or (max_hops is not None and least > max_hops):
            break
        length, everyone = least, reduce(DataFrame.unionByName, waiting)
        waiting, level = [checkpointed(everyone.where(F.col("bound") > length))], checkpointed(everyone.where(F.col("bound") == length))
        while not level.isEmpty():
            grown = level.join(steps, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            grown = checkpointed(grown.select(F.concat("path", F.array("dst")).alias("path"), (F.col("hops") + 1).alias("hops"), (F.col("confidence") * F.col("more")).alias("confidence"), (F.col("hops") + 1 + F.col("left")).alias("bound")))
            arrived = F.element_at("path", -1) == F.lit(target)
            done.append(grown.where(arrived))
            waiting.append(grown.where(~arrived & (F.col("bound") > length)))
            level = grown.where(~arrived & (F.col("bound") == length))
        found = sum(d.count() for d in done)
    routes = (reduce(DataFrame.unionByName, done) if done else begun.limit(0)).withColumn("route", F.array_join("path", ">"))
    top = routes.orderBy("hops", "route").limit(k).drop("bound")
    return top.withColumn("rank", F.row_number().over(Window.orderBy("hops", "route")))  # k rows


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """``cycle`` (closed at its least node) and ``length`` of all simple cycles up to ``max_length`` edges.

    Only paths whose first node is the least are grown, so each cycle comes once.
    """
    plain = edges.where("src != dst").select("src", "dst").distinct()
    level = plain.where(F.col("dst") > F.col("src")).select(F.array("src", "dst").alias("path"))
    closed = []
    step = plain.withColumnsRenamed({"src": "a", "dst": "b"})
    for length in range(2, max_length + 1):
        grown = level.join(step, F.element_at("path", -1) == F.col("a"))
        closed.append(grown.where(F.col("b") == F.element_at("path", 1)).select(F.concat("path", F.array("b")).alias("cycle"), F.lit(length).alias("length")))
        level = grown.where((F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
    return reduce(DataFrame.unionByName, closed)


def canonical_cycle(cycle: Column) -> Column:
    """Rotation of an open cycle that starts at its least element."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, 1, at - 1))


def induced(edges: DataFrame, component, depth: int) -> DataFrame:
    """Edges whose ends both lie within ``depth`` forward hops of a component."""
    start = edges.sparkSession.createDataFrame([(component,)], "id string").select(F.col("id").cast(edges.schema["src"].dataType))
    inside = checkpointed(reach(edges, start, "forward", depth).select("id"))
    return edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")


def crawl(edges: DataFrame, starts: DataFrame, direction: str = "forward", depth: int | None = None) -> DataFrame:
    """``id, depth, parents, edges_out``: reach from several starts with all parents one level up.

    ``direction`` is forward, backward or both; ``edges_out`` counts the nodes that a
    node points to, whatever the direction.
    """
    reached = checkpointed(reach(edges, starts, direction, depth))
    steps = reduce(DataFrame.unionByName, [edges.select(F.col(a).alias("up"), F.col(b).alias("id")) for a, b in _steps(direction)])
    above = reached.select(F.col("id").alias("up"), (F.col("distance") + 1).alias("distance"))
    parents = steps.join(above, "up").groupBy("id", "distance").agg(F.sort_array(F.collect_set("up")).alias("parents"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("edges_out"))
    found = reached.join(parents, ["id", "distance"], "left").join(out, "id", "left")
    return found.select("id", F.col("distance").alias("depth"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.coalesce("edges_out", F.lit(0)).alias("edges_out"))


def attenuated(edges: DataFrame, component, floor: float = 0.5, depth: int = 3) -> DataFrame:
    """``id, confidence``: best product of hop confidences from a component, pruned below ``floor``."""
    best = edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= floor)
    level = best.where(F.col("src") == F.lit(component)).select(F.col("dst").alias("id"), "confidence")
    levels = [level]
    for _ in range(depth - 1):
        level = level.withColumnRenamed("confidence", "so_far").join(best, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("so_far") * F.col("confidence")).alias("confidence"))
        level = level.where(F.col("confidence") >= floor).groupBy("id").agg(F.max("confidence").alias("confidence"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).where(F.col("id") != F.lit(component)).groupBy("id").agg(F.max("confidence").alias("confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, incoming_edges, outgoing_edges`` of every endpoint."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("incoming_edges"), F.sum("o").alias("outgoing_edges"))


def listing(nodes: DataFrame, edges: DataFrame, component_type: str | None = None, min_confidence: float = 0.0, source_type: str | None = None) -> DataFrame:
    """``name, type, incoming_edges, outgoing_edges``; degrees count all edges, filters need any incident edge."""
    out = nodes.where(F.col("component_type") == component_type) if component_type else nodes
    if min_confidence or source_type:
        kept = filtered(edges, min_confidence, source_type)
        ends = kept.select(F.col("src").alias("id")).unionByName(kept.select(F.col("dst").alias("id")))
        out = out.join(ends, "id", "left_semi")
    return out.join(degrees(edges), "id", "left").select(F.col("id").alias("name"), F.coalesce(F.nullif("component_type", F.lit("")), F.lit("unknown")).alias("type"), F.coalesce("incoming_edges", F.lit(0)).alias("incoming_edges"), F.coalesce("outgoing_edges", F.lit(0)).alias("outgoing_edges"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("id").distinct()
    a = edges.join(known.withColumnRenamed("id", "src").withColumn("has_src", F.lit(True)), "src", "left")
    b = a.join(known.withColumnRenamed("id", "dst").withColumn("has_dst", F.lit(True)), "dst", "left")
    return b.where(F.col("has_src").isNull() | F.col("has_dst").isNull()).drop("has_src", "has_dst")


def pruned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def weak_only(edges: DataFrame, limit: float = 0.55) -> DataFrame:
    """Nodes all of whose edges stay below ``limit``."""
    ends = edges.select(F.col("src").alias("id"), "confidence").unionByName(edges.select(F.col("dst").alias("id"), "confidence"))
    return ends.groupBy("id").agg(F.max("confidence").alias("best")).where(F.col("best") < limit)


def tier_distribution(edges: DataFrame) -> DataFrame:
    """``tier, edges, percent`` of the tiers that occur."""
    counted = edges.groupBy(tier(F.col("confidence")).alias("tier")).agg(F.count(F.lit(1)).alias("edges"))
    return counted.withColumn("percent", F.round(100.0 * F.col("edges") / F.sum("edges").over(Window.partitionBy()), 4))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts and the quality score, mean confidence times 100; zeros for an empty graph."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.coalesce(F.avg("confidence") * 100, F.lit(0.0)), 4).alias("quality_score"), F.countDistinct("type").alias("edge_types"))
    return n.crossJoin(e)  # one row by one row


def lifted(edges: DataFrame, files: DataFrame) -> DataFrame:
    """File edges as component edges: ``files(file, component)``; the best edge gives type and confidence."""
    if files.count() > BROADCAST:
        files = files.hint("shuffle_hash")  # its size on disk says little about its size in a task; a part of it is held, the edges are not sorted
    a = edges.join(files.select(F.col("file").alias("src"), F.col("component").alias("from")), "src")
    b = a.join(files.select(F.col("file").alias("dst"), F.col("component").alias("to")), "dst").where(F.col("from") != F.col("to"))
    # numbers first, which merge in place; the types of a pair are few
    by_type = b.groupBy(F.col("from").alias("src"), F.col("to").alias("dst"), "type").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    return by_type.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.max_by("type", F.struct("confidence", F.col("type"))).alias("type"), F.sum("n").alias("evidence"))


def merge_sources(markdown: DataFrame, code: DataFrame) -> DataFrame:
    """Edges of two origins: where both see a pair the confidences combine as independent evidence."""
    m = markdown.groupBy("src", "dst").agg(F.max("confidence").alias("m"))
    c = code.groupBy("src", "dst").agg(F.max("confidence").alias("c"))
    kind = F.when(F.col("m").isNull(), "code").when(F.col("c").isNull(), "markdown").otherwise("both")
    return m.join(c, ["src", "dst"], "full").select("src", "dst", F.coalesce(noisy_or(F.col("m"), F.col("c")), "m", "c").alias("confidence"), kind.alias("source_type"))


def renamed(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Endpoints through ``aliases(alias, canonical_id)``; duplicates keep the best confidence, loops go."""
    a = edges.join(aliases.select(F.col("alias").alias("src"), F.col("canonical_id").alias("to_src")), "src", "left")
    b = a.join(aliases.select(F.col("alias").alias("dst"), F.col("canonical_id").alias("to_dst")), "dst", "left")
    c = b.select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst"), "type", "confidence").where("src != dst")
    return c.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def hypotheses(nodes: DataFrame, edges: DataFrame, left: str, right: str, confidence: float, most: int = 100_000_000) -> DataFrame:
    """Pairs of two component types without an edge: a product by meaning, refused above ``most`` pairs."""
    a = nodes.where(F.col("component_type") == left).select(F.col("id").alias("src"))
    b = nodes.where(F.col("component_type") == right).select(F.col("id").alias("dst"))
    if a.count() * b.count() > most:
        raise ValueError(f"more than {most} pairs of {left} and {right}")
    return a.crossJoin(b).join(edges.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("confidence", F.lit(confidence))
