"""Breadth-first search by joins of the frontier with the arcs, level by level.

A level goes down or up. Down: the frontier's arcs, less what the last two levels hold. Up: the arcs that lead to nodes
seen so far are dropped first, once and for all, and what is left (arcs into unvisited nodes) is asked for the frontier.
Up pays where the frontier has many arcs, so levels switch by their number against that of the arcs that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.scan import indexed
from arbora.plans.shared import derived, forget, saved, stored, unbroadcast

from .graph import top_degree

#: A level goes up if the frontier has at least one in so many of the arcs that are left.
ALPHA = 14


def bfs(arcs: DataFrame, start: int | DataFrame, max_levels: int | None = None, alpha: int = ALPHA, trace: list[str] | None = None) -> DataFrame:
    """(node, distance, parent) of the nodes that start (a node, or a DataFrame of nodes of different components) reaches.

    parent is the smallest neighbour one level up, null at the start. arcs: symmetric. trace: gets "down" or "up" for each level.
    """
    starts = arcs.sparkSession.range(1).select(F.lit(start).cast("long").alias("node")) if isinstance(start, int) else start.select(F.col("node").cast("long"))
    live = derived(stored(arcs, ["src", "dst"], "arcs").where("src <> dst"))  # parallel arcs only count more often
    degree = saved(live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "degrees")
    n, left = degree.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0))).first()
    level, own = 0, False
    front = saved(starts.select("node", F.lit(0).cast("long").alias("distance"), F.lit(None).cast("long").alias("parent")), "bfs")
    parts, fresh = [front], [front]  # fresh: levels whose arcs haven't been dropped
    while max_levels is None or level < max_levels:
        if front.isEmpty():
            break
        going = degree.join(front, "node", "left_semi").agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
        level += 1
        up = going * alpha >= left
        if trace is not None:
            trace.append("up" if up else "down")
        if up:
            seen = unbroadcast(_all(fresh).select(F.col("node").alias("dst")), n)
            new = saved(live.join(seen, "dst", "left_anti"), "arcs")
            if own:  # not the given arcs
                forget(live)
            live, left, fresh, own = new, new.count(), [], True
        step = live.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        if not up:  # a level's neighbours lie at most one level away, so only the last two levels can hold them
            step = step.join(unbroadcast(_all(parts[-2:]).select("node"), n), "node", "left_anti")
        front = saved(step.select("node", F.lit(level).cast("long").alias("distance"), "parent"), "bfs")
        parts.append(front)
        fresh.append(front)
        if len(parts) >= 16:  # keeps the plan short; the last two levels stay apart
            merged = saved(_all(parts[:-2]), "bfs")
            fresh = [merged, *parts[-2:]] if len(fresh) > 2 else fresh
            parts = [merged, *parts[-2:]]
    return _all(parts).select("node", "distance", "parent")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


#: Searches in a word, words in a mask, and masks that are carried at once.
BITS, WORDS, MASKS = 64, 16, 4


def eccentricities(arcs: DataFrame, starts: DataFrame, enough: int | None = None) -> DataFrame:
    """(node, ecc): the largest distance from each distinct start (node), 0 for one without arcs. arcs: symmetric.

    WORDS * BITS searches are one row of BIGINTs for each node that some of them reach on a level, joined by bit_or; MASKS of
    these go side by side, until a start has `enough` or all are done (later starts are then left out).
    """
    spark = arcs.sparkSession
    arcs = saved(arcs.select("src", "dst").where("src <> dst").distinct(), "arcs")
    starts = indexed(starts.select(F.col("node").cast("long").alias("node")).distinct(), ["node"], "i")
    starts = starts.select("node", F.expr(f"i div {BITS * WORDS}").alias("mask"), F.expr(f"cast(i div {BITS} % {WORDS} as int)").alias("word"), F.expr(f"shiftleft(1L, cast(i % {BITS} as int))").alias("bits"))
    starts = saved(starts, "starts")
    masks = (starts.agg(F.max("mask")).first()[0] or 0) + 1
    done = []
    for first in range(0, masks, MASKS):
        batch = starts.where((F.col("mask") >= first) & (F.col("mask") < first + MASKS))
        done.append(saved(_ended(batch, _last_levels(arcs, batch)), "ended"))
        if enough is not None and (done[-1].agg(F.max("ecc")).first()[0] or 0) >= enough:
            break
    return _all(done) if done else spark.createDataFrame([], "node long, ecc long")


def _last_levels(arcs: DataFrame, batch: DataFrame) -> list[tuple[int, int, int, int]]:
    """(mask, word, bits, level): the searches that reached some node on each level."""
    words = [f"b{k}" for k in range(WORDS)]
    either = [F.bit_or(w).alias(w) for w in words]
    front = batch.select("node", "mask", *[F.when(F.col("word") == k, F.col("bits")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)])
    before, level, out = None, 0, []
    while True:
        level += 1
        step = front.withColumnRenamed("node", "src").join(arcs, "src").groupBy(F.col("dst").alias("node"), "mask").agg(*either)
        near = front if before is None else front.unionByName(before).groupBy("node", "mask").agg(*either)  # neighbours lie at most one level away
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"old_{w}", F.lit(0).cast("long")))).alias(w) for w in words]
        new = step.join(near.withColumnsRenamed({w: f"old_{w}" for w in words}), ["node", "mask"], "left").select("node", "mask", *fresh)
        new = saved(new.where(" or ".join(f"{w} <> 0" for w in words)), "search")
        reached = new.groupBy("mask").agg(*either).collect()  # at most MASKS rows
        if not reached:
            return out
        out += [(r["mask"], k, r[w], level) for r in reached for k, w in enumerate(words) if r[w]]
        if before is not None and level > 2:
            forget(before)
        before, front = front, new


def _ended(batch: DataFrame, reached: list[tuple[int, int, int, int]]) -> DataFrame:
    """(node, ecc) of a batch: the last level on which each search reached a node."""
    last = F.broadcast(batch.sparkSession.createDataFrame(reached, "mask long, word int, got long, level long"))  # MASKS * WORDS rows for each level
    hits = batch.join(last, ["mask", "word"], "left").withColumn("hit", F.when(F.col("bits").bitwiseAND(F.col("got")) != 0, F.col("level")))
    return hits.groupBy("node").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("ecc"))


def widest(arcs: DataFrame, nodes: DataFrame, lower: int, enough: int | None = None) -> int:
    """The largest eccentricity of nodes (node), or `lower` if none is larger; any at least `enough` may stand for it. arcs: symmetric, connected.

    A node lies at most one hop farther from all others than its guard, the neighbour of the highest degree. Where guards are
    at most half as many as nodes, they are searched first, and then only nodes whose guards leave room above the bound.
    """
    nodes = saved(nodes.select("node").distinct(), "fringe")
    ties = arcs.select("src", "dst").where("src <> dst").distinct()
    degree = ties.groupBy("dst").agg(F.count("*").alias("degree"))
    near = ties.join(nodes.toDF("src"), "src", "left_semi").join(degree, "dst")
    near = near.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("degree", (-F.col("dst")).alias("x")))["x"].alias("x")).select("node", (-F.col("x")).alias("guard"))
    near = saved(near, "guards")
    guards = near.select(F.col("guard").alias("node")).distinct()
    if 2 * guards.count() <= nodes.count():
        found = eccentricities(arcs, guards, enough)
        lower = max(lower, found.agg(F.max("ecc")).first()[0] or 0)
        if enough is not None and lower >= enough:
            return lower
        nodes = near.join(found.where(F.col("ecc") + 1 > lower).toDF("guard", "ecc"), "guard").select("node")
    return max(lower, eccentricities(arcs, nodes, enough).agg(F.max("ecc")).first()[0] or 0)


def with_unreached(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found with all nodes (node); distance is null where start doesn't reach."""
    return nodes.join(found, "node", "left")


def spanning_tree(found: DataFrame) -> DataFrame:
    """(src, dst): parent to child arcs of a search."""
    return found.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))


def eccentricity(found: DataFrame) -> DataFrame:
    """(ecc, farthest): the largest distance, and the smallest node at it."""
    return found.agg(F.max(F.struct("distance", (-F.col("node")).alias("x"))).alias("m")).select(F.col("m.distance").alias("ecc"), (-F.col("m.x")).alias("farthest"))


def _far(arcs: DataFrame, start: int) -> tuple[DataFrame, int, int]:
    found = saved(bfs(arcs, start), "search")
    ecc, far = eccentricity(found).first()
    return found, ecc, far


def middle(found: DataFrame, node: int, hops: int) -> int:
    """The node `hops` parents above, by tables of 2**k-th ancestors."""
    up = found.select("node", "parent")
    while hops:
        if hops & 1:
            node = up.where(F.col("node") == node).first()["parent"]
        hops >>= 1
        if hops:
            up = saved(up.join(up.toDF("parent", "far"), "parent").select("node", F.col("far").alias("parent")), "ancestors")
    return node


def diameter_bounds(arcs: DataFrame) -> tuple[int, int]:
    """(lower, upper) bound of the diameter of the component of the node of highest degree; they are equal.

    Two double sweeps give a central node; then the eccentricities of the nodes farthest from it close the gap, level
    by level, all nodes of a level side by side, those with few neighbours by way of these.
    """
    start = top_degree(arcs)
    if start is None:
        return 0, 0
    arcs = saved(arcs.select("src", "dst"), "arcs")
    lower = 0
    for _ in range(2):
        _, _, a = _far(arcs, start)
        found, ecc, b = _far(arcs, a)
        lower, start = max(lower, ecc), middle(found, b, ecc // 2)
    found, ecc, _ = _far(arcs, start)
    lower, upper = max(lower, ecc), 2 * ecc
    for level in range(ecc, 0, -1):
        if lower >= upper:
            break
        lower = widest(arcs, found.where(F.col("distance") == level), lower, upper)
        upper = max(lower, 2 * (level - 1))  # nodes nearer to the centre are at most so far apart
    return lower, upper
