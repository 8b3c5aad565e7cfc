"""Bridges: edges whose removal separates their ends.

arcs: (src, dst), symmetric; parallel arcs count as one edge, self-loops never are bridges and each component is solved
by itself. Results hold one row for each stored arc, so a bridge is at least two rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.scan import prefix_sum
from arbora.plans.shared import derived, saved, stored

from .bfs import bfs
from .components import components, components_and_forest
from .euler import numbered_edges, numbers_of, search_visits
from .lca import by_inlabel, index_of
from .rmq import interval_minmax

#: The parent of all component roots in numberings; no node has this id.
TOP = -(1 << 62)

STRATEGIES = ("tv", "ck", "hybrid", "crossing", "local")

#: Arcs of a component that a task of the local strategy may hold: about 1 GB in Python.
LOCAL_ARCS = 2_000_000


class Disconnected(ValueError):
    pass


def bridges(arcs: DataFrame, strategy: str = "auto", connected: bool = False) -> DataFrame:
    """arcs with is_bridge. strategy: one of STRATEGIES, or auto (tv). connected: raises unless there is one component."""
    arcs = stored(arcs, arcs.columns, "graph")
    simple = derived(arcs.select("src", "dst").where("src <> dst"))  # parallel arcs change no result
    if connected and components(simple.unionByName(arcs.select("src", "dst").where("src = dst").distinct())).select("component").distinct().limit(2).count() > 1:
        raise Disconnected("the graph has several components")
    ends = {"auto": _tarjan_vishkin, "tv": _tarjan_vishkin, "ck": _search_and_mark, "hybrid": _tour_and_mark, "crossing": _crossing, "local": _local}[strategy](simple)
    flags = saved(ends.select(F.least("node", "parent").alias("_a"), F.greatest("node", "parent").alias("_b")), "flags").withColumn("_f", F.lit(True))
    out = arcs.join(flags, (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b")), "left")  # keys are no columns, so that they aren't shuffled
    return out.select(*arcs.columns, F.coalesce("_f", F.lit(False)).alias("is_bridge"))


def forest_numbers(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent, level, pre, size) of a spanning forest with its components: roots are the smallest nodes, pre is from 0 over all trees."""
    tops = comp.where("node = component").select(F.lit(TOP).alias("src"), F.col("node").alias("dst"))
    nodes = numbered_edges(edges.unionByName(tops), TOP).where(F.col("node") != TOP)
    return saved(nodes.select("node", F.when(F.col("parent") != TOP, F.col("parent")).alias("parent"), (F.col("level") - 1).alias("level"), (F.col("pre") - 2).alias("pre"), "size"), "forest")


def neighbour_minmax(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, pre, lo, hi): least and greatest preorder number among the neighbours but the tree parent; without any, the number of nodes + 1 and -1."""
    numbers = nodes.select(F.col("node").alias("dst"), F.col("pre").alias("p"))
    own = simple.join(nodes.select(F.col("node").alias("src"), "parent"), "src").where("parent is null or dst <> parent")
    seen = own.join(numbers, "dst").groupBy(F.col("src").alias("node")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    n = nodes.agg(F.count("*").alias("n"))
    return nodes.select("node", "pre").join(seen, "node", "left").crossJoin(F.broadcast(n)).select("node", "pre", F.coalesce("lo", F.col("n") + 1).alias("lo"), F.coalesce("hi", F.lit(-1).cast("long")).alias("hi"))


def subtree_minmax(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, lo, hi): the least lo and greatest hi of neighbour_minmax over each subtree."""
    values = neighbour_minmax(simple, nodes).select(F.col("pre").alias("pos"), "lo", "hi")
    asked = nodes.select(F.col("node").alias("key"), F.col("pre").alias("first"), (F.col("pre") + F.col("size") - 1).alias("last"))
    return interval_minmax(values, asked).withColumnRenamed("key", "node")


def _tarjan_vishkin(simple: DataFrame) -> DataFrame:
    return _by_spans(simple, *components_and_forest(simple, minimum=False))


def _by_spans(simple: DataFrame, comp: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = forest_numbers(comp, edges)
    spans = subtree_minmax(simple, nodes).join(nodes, "node")
    return spans.where("parent is not null and lo >= pre and hi <= pre + size - 1").select("node", "parent")


def marked(simple: DataFrame, numbered: DataFrame) -> DataFrame:
    """(node): those below which some non-tree edge has exactly one end. numbered: of a tree whose top is TOP.

    Both ends of a non-tree edge climb to their lowest common ancestor, a path of the inlabel decomposition at a time:
    an interval of levels on each, of which there are at most log n. Intervals are marked by differences at their ends,
    whose sums along the paths are above 0 on marked nodes.
    """
    tree = numbered.where("parent is not null").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    rest = saved(simple.where("src < dst").join(tree, ["src", "dst"], "left_anti").withColumn("qid", F.monotonically_increasing_id()), "rest")
    nodes, paths = index_of(numbered)
    meet = by_inlabel(rest.select("qid", F.col("src").alias("x"), F.col("dst").alias("y")), nodes, paths)
    own = nodes.select("node", "inlabel", "level")
    ends = meet.select(F.explode(F.array("x", "y")).alias("node"), "lca").where("node <> lca").distinct()  # a node climbs once to each ancestor
    now = saved(ends.join(own, "node").join(own.toDF("lca", "to", "stop"), "lca").select("inlabel", "level", "to", "stop"), "climbing")
    tops = paths.select("inlabel", F.col("parent_level"), F.col("parent_inlabel"))
    spans = []
    while not now.isEmpty():
        now = now.join(tops, "inlabel").withColumn("on", F.col("inlabel") == F.col("to"))
        step = saved(now.groupBy("inlabel", "level", "to", "stop", "on", "parent_level", "parent_inlabel").agg(F.count("*").alias("n")), "climbing")  # those that meet go on as one
        spans.append(step.select("inlabel", F.when(F.col("on"), F.col("stop")).otherwise(F.coalesce("parent_level", F.lit(-1))).alias("above"), "level", "n"))
        now = step.where("not on and not (parent_inlabel = to and parent_level = stop)").select(F.col("parent_inlabel").alias("inlabel"), F.col("parent_level").alias("level"), "to", "stop")
    if not spans:
        return numbered.select("node").limit(0)
    spans = [x.select("inlabel", F.explode(F.array(F.struct(F.col("level").alias("level"), F.col("n").alias("w")), F.struct(F.col("above").alias("level"), (-F.col("n")).alias("w")))).alias("x")) for x in spans]
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    w = every.select("inlabel", "x.level", "x.w").groupBy("inlabel", "level").agg(F.sum("w").alias("w"))
    # Sums run from the deep end of each path up; the rows above a path's first level close its sum, so paths don't mix.
    points = own.select("inlabel", "level", "node").join(w, ["inlabel", "level"], "full").select("inlabel", "level", "node", F.coalesce("w", F.lit(0)).alias("w"))
    return prefix_sum(points.withColumn("down", -F.col("level")), ["inlabel", "down"], "w", "on").where("on > 0 and node is not null").select("node")


def _unmarked(simple: DataFrame, numbered: DataFrame) -> DataFrame:
    nodes = numbered.where(F.col("parent") != TOP).select("node", "parent")
    return nodes.join(marked(simple, numbered).distinct(), "node", "left_anti")


def _search_and_mark(simple: DataFrame) -> DataFrame:
    starts = saved(components(simple).select(F.col("component").alias("node")).distinct(), "starts")
    found = bfs(simple, starts).select("node", F.col("distance") + 1, F.coalesce("parent", F.lit(TOP)).alias("parent"))
    found = found.toDF("node", "distance", "parent").unionByName(starts.sparkSession.range(1).select(F.lit(TOP).alias("node"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast("long").alias("parent")))
    return _unmarked(simple, saved(numbers_of(search_visits(saved(found, "search"), TOP), TOP), "numbers"))


def _tour_and_mark(simple: DataFrame) -> DataFrame:
    comp, edges = components_and_forest(simple, minimum=False)
    tops = comp.where("node = component").select(F.lit(TOP).alias("src"), F.col("node").alias("dst"))
    return _unmarked(simple, saved(numbered_edges(edges.unionByName(tops), TOP), "numbers"))


def _crossing(simple: DataFrame) -> DataFrame:
    """An edge is a bridge if the non-tree ends in the subtree below it, less two for each non-tree edge whose ends meet there, sum to 0."""
    comp, edges = components_and_forest(simple, minimum=False)
    tops = comp.where("node = component").select(F.lit(TOP).alias("src"), F.col("node").alias("dst"))
    numbered = saved(numbered_edges(edges.unionByName(tops), TOP), "numbers")
    tree = numbered.where("parent is not null").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    rest = saved(simple.where("src < dst").join(tree, ["src", "dst"], "left_anti").withColumn("qid", F.xxhash64("src", "dst")), "rest")
    nodes, paths = index_of(numbered)
    meet = by_inlabel(rest.select("qid", F.col("src").alias("x"), F.col("dst").alias("y")), nodes, paths)
    weights = rest.select(F.col("src").alias("node"), F.lit(1).alias("w")).unionByName(rest.select(F.col("dst").alias("node"), F.lit(1).alias("w"))).unionByName(meet.select(F.col("lca").alias("node"), F.lit(-2).alias("w")))
    sums = weights.groupBy("node").agg(F.sum("w").alias("w"))
    run = saved(prefix_sum(numbered.join(sums, "node", "left").select("node", "parent", "pre", "size", F.coalesce("w", F.lit(0)).alias("w")), ["pre"], "w", "upto"), "weights")
    last = run.select(F.col("pre").alias("end"), F.col("upto").alias("sum_end"))
    inside = run.withColumn("end", F.col("pre") + F.col("size") - 1).join(last, "end").where(F.col("sum_end") - F.col("upto") + F.col("w") == 0)
    return inside.where((F.col("parent").isNotNull()) & (F.col("parent") != TOP)).select("node", "parent")


def _local(simple: DataFrame) -> DataFrame:
    """Low-link search in a task for each component of at most LOCAL_ARCS arcs; interval minima, as by tv, in larger ones, which no task has to hold."""
    comp, edges = components_and_forest(simple, minimum=False)
    comp = saved(comp, "components")
    sizes = simple.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).join(comp, "node").groupBy("component").agg(F.sum("n").alias("n"))
    large = saved(sizes.where(F.col("n") > LOCAL_ARCS).select("component"), "large")
    inside = saved(comp.join(large, "component", "left_semi").select("node", "component"), "large")
    apart = simple.join(inside.select(F.col("node").alias("src")), "src", "left_anti")
    own = apart.join(comp.toDF("src", "component"), "src")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            near.setdefault(a, []).append(b)
        start = min(near)
        order, low, out, stack = {start: 0}, {start: 0}, [], [(start, None, iter(near[start]))]
        while stack:
            v, up, rest = stack[-1]
            for w in rest:
                if w == up:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                    continue
                order[w] = low[w] = len(order)
                stack.append((w, v, iter(near[w])))
                break
            else:
                stack.pop()
                if up is not None:
                    low[up] = min(low[up], low[v])
                    if low[v] == order[v]:
                        out.append((v, up))
        return pd.DataFrame(out, columns=["node", "parent"]).astype("int64")

    ends = own.groupBy("component").applyInPandas(solve, "node long, parent long")
    if large.isEmpty():
        return ends
    members = inside.select(F.col("node").alias("src"))
    return ends.unionByName(_by_spans(saved(simple.join(members, "src", "left_semi"), "simple"), inside, edges.join(members, "src", "left_semi")))


def bridge_count(flagged: DataFrame) -> DataFrame:
    """(bridges): arcs that are bridges."""
    return flagged.agg(F.coalesce(F.sum(F.col("is_bridge").cast("long")), F.lit(0)).alias("bridges"))
