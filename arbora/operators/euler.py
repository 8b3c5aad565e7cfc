"""Euler tours of trees and the numberings that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.pointer import sums_to_tail
from arbora.plans.scan import indexed, placed
from arbora.plans.shared import saved

from .graph import both_ways, symmetrise


def visits(edges: DataFrame, root: int) -> DataFrame:
    """(parent, node, down, up, level) of each node but root: the places of the arcs into it and back in the tour, stored.

    Nodes with one neighbour (but root) are left out first, and the list of the other arcs is ranked, weighted by the leaves
    between: after b -> a come the leaves of a up to the next neighbour that is none, two arcs for each. Leaves take their places
    from the arc before them. So a tree whose nodes are mostly leaves has a short list.
    """
    edges = saved(symmetrise(edges).where("src < dst"), "tree")
    nodes = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))))
    nodes = nodes.groupBy("node").agg(F.count("*").alias("degree"), F.min("near").alias("near"))
    nodes = saved(nodes.withColumn("leaf", (F.col("degree") == 1) & (F.col("node") != root)), "degrees")
    inner = saved(nodes.where("not leaf").select("node"), "inner")
    core = edges.join(inner.toDF("src"), "src", "left_semi").join(inner.toDF("dst"), "dst", "left_semi")
    leaves = nodes.where("leaf").select(F.col("near").alias("src"), F.col("node").alias("dst"))
    own = both_ways(core).withColumn("core", F.lit(1)).unionByName(leaves.withColumn("core", F.lit(0)))
    own = saved(placed(own, ["src", "dst"], "core").withColumn("leaves", F.col("_place") + 1 - F.col("_upto")), "around")  # leaves: up to this arc
    return saved(_among(own, root), "visits")


def _among(own: DataFrame, root: int) -> DataFrame:
    """visits() from the arcs out of nodes that aren't leaves, with _upto and leaves, the numbers of core and leaf arcs up to each."""
    n = own.agg(F.max("_upto")).first()[0]
    if not n:  # all nodes but root are leaves
        return own.select(F.col("src").alias("parent"), F.col("dst").alias("node"), (2 * F.col("_place")).alias("down"), (2 * F.col("_place") + 1).alias("up"), F.lit(1).cast("long").alias("level"))
    is_core = F.col("core") == 1
    ends = own.groupBy("src").agg(F.min(F.when(is_core, F.col("_upto"))).alias("first"), F.max("_upto").alias("last"), F.min(F.when(is_core, F.col("leaves"))).alias("at_first"), F.max("leaves").alias("all"), F.min(F.col("leaves") - F.when(is_core, 0).otherwise(1)).alias("none"))
    ends = saved(ends, "ends")
    arcs = own.where(is_core).select(F.col("_upto").alias("id"), "src", "dst", "leaves")
    after = arcs.select((F.col("id") - 1).alias("id"), F.col("leaves").alias("then"))
    arcs = arcs.join(ends, "src").join(after, "id", "left").withColumn("wraps", F.col("id") == F.col("last"))
    between = F.when(F.col("wraps"), F.col("all") - F.col("none") + F.col("at_first")).otherwise(F.col("then")) - F.col("leaves")
    arcs = saved(arcs.select("id", "src", "dst", "leaves", F.when(F.col("wraps"), F.col("first")).otherwise(F.col("id") + 1).alias("turn"), (1 + 2 * between).alias("w")), "tour-arcs")
    back = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("id").alias("back"), F.col("turn").alias("to"), "w")  # where the arc that comes back turns to
    start = ends.where(F.col("src") == root).first()
    cut = F.col("to") == start["first"]
    links = saved(arcs.select("id", "src", "dst", "leaves").join(back, ["src", "dst"]).select("id", "src", "dst", "leaves", "back", F.when(~cut, F.col("to")).alias("to"), F.when(cut, 0).otherwise(F.col("w")).cast("long").alias("w")), "tour-links")
    rest = saved(sums_to_tail(links.select("id", "to", "w")), "ranks")
    whole = rest.agg(F.max("w")).first()[0] + 2 * (start["at_first"] - start["none"])
    ranked = saved(links.join(rest.withColumnRenamed("w", "rest"), "id").select("id", "src", "dst", "leaves", "back", (F.lit(whole) - F.col("rest")).alias("rank")), "ranked")
    pairs = ranked.select("id", "src", "dst", "leaves", "rank").join(ranked.select(F.col("back").alias("id"), F.col("id").alias("in"), F.col("rank").alias("rank_in")), "id")
    pairs = pairs.withColumn("goes_down", (F.col("rank") < F.col("rank_in")).cast("long"))
    tour = placed(pairs, ["rank"], "goes_down")
    # after this arc so many arcs have gone down less up; leaves change nothing
    tour = saved(tour.withColumn("level", 2 * F.col("_upto") - F.col("_place") - 1).drop("_place", "_upto"), "core-tour")
    core = tour.where("goes_down = 1").select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.col("rank").alias("down"), F.col("rank_in").alias("up"), "level")
    # a leaf behind core arc `id` of its node: its place follows from that of the arc that comes back along `id`
    arrived = tour.select(F.col("src"), "id", (F.col("rank_in") + 1 - 2 * F.col("leaves")).alias("base"), (F.col("level") - 2 * F.col("goes_down") + 2).alias("below"))
    gaps = arrived.select(F.col("id").alias("_upto"), "src", "base", "below")
    first = ends.where("first is not null").select("src", (F.col("first") - 1).alias("_upto"), F.col("last").alias("id"), F.col("all"), F.col("none"))
    wrapped = first.join(arrived.drop("src"), "id").select("_upto", "src", F.when(F.col("src") == root, -2 * F.col("none")).otherwise(F.col("base") + 2 * (F.col("all") - F.col("none"))).alias("base"), F.when(F.col("src") == root, 1).otherwise(F.col("below")).cast("long").alias("below"))
    gaps = saved(gaps.unionByName(wrapped), "gaps")
    leaves = own.where(~is_core).join(gaps, ["_upto", "src"]).withColumn("down", F.col("base") + 2 * (F.col("leaves") - 1))
    return core.unionByName(leaves.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "down", (F.col("down") + 1).alias("up"), F.col("below").alias("level")))


#: Trees of a search with more levels than this are ranked as lists.
FLAT = 32


def search_visits(found: DataFrame, root: int) -> DataFrame:
    """visits() of a search tree (node, distance, parent), stored, whose only row without a parent is root, at distance 0.

    A search has taken a round for each level, so its levels are known. If they are at most FLAT, sizes are summed up level by
    level and places are handed down; both touch the inner nodes of a level only, and all nodes are sorted once. Deeper
    trees are ranked as lists.
    """
    height = found.agg(F.max("distance")).first()[0]
    if height > FLAT:
        return visits(found.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")), root)
    sizes: list[DataFrame] = []  # (node, size) of nodes with children, from the last level up
    for level in range(height, 0, -1):
        own = found.where(F.col("distance") == level)
        if sizes:
            own = own.join(sizes[-1], "node", "left")
        size = F.coalesce("size", F.lit(1)) if sizes else F.lit(1)
        sizes.append(saved(own.groupBy(F.col("parent").alias("node")).agg((F.sum(size) + 1).alias("size")), "sizes"))
    if not sizes:
        return found.select("parent", "node", *[F.lit(0).cast("long").alias(c) for c in ("down", "up", "level")]).limit(0)
    every = sizes[0]
    for x in sizes[1:]:
        every = every.unionByName(x)
    inner = saved(every.join(found, "node"), "inner")  # (node, size, distance, parent)
    tops = inner.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    own = found.where("parent is not null").join(every, "node", "left").join(tops, "parent")
    own = own.select("distance", "parent", (~F.coalesce(F.col("node") > F.col("above"), F.lit(True))).alias("wrapped"), "node", F.coalesce("size", F.lit(1)).alias("size"))
    own = placed(own, ["distance", "parent", "wrapped", "node"], "size").withColumn("before", F.col("_upto") - F.col("size")).drop("_place", "_upto", "wrapped")
    first = saved(own.groupBy(F.col("parent").alias("node")).agg(F.min("before").alias("first")), "first")
    inner = saved(inner.join(first, "node").join(own.select("node", "before"), "node", "left"), "inner")
    starts = [inner.where("parent is null").select("node", (F.lit(2).cast("long") - F.col("first")).alias("start"))]  # a child's number is its `before` and its parent's start
    for level in range(1, height):
        step = inner.where(F.col("distance") == level).join(starts[-1].toDF("parent", "start"), "parent")
        starts.append(saved(step.select("node", (F.col("before") + F.col("start") + 1 - F.col("first")).alias("start")), "starts"))
    every = starts[0]
    for x in starts[1:]:
        every = every.unionByName(x)
    down = 2 * (F.col("before") + F.col("start")) - 3 - F.col("distance")
    own = own.join(every.toDF("parent", "start"), "parent").select("parent", "node", down.alias("down"), (down + 2 * F.col("size") - 1).alias("up"), F.col("distance").alias("level"))
    return saved(own, "visits")


def tour_of(seen: DataFrame) -> DataFrame:
    """(src, dst, rank) of both arcs to each node of visits()."""
    there = F.struct(F.col("parent").alias("src"), F.col("node").alias("dst"), F.col("down").alias("rank"))
    return seen.select(F.inline(F.array(there, F.struct(F.col("node").alias("src"), F.col("parent").alias("dst"), F.col("up").alias("rank")))))


def numbers_of(seen: DataFrame, root: int) -> DataFrame:
    """numbering() from visits()."""
    pre = F.expr("(down + level + 1) div 2 + 1")
    nodes = seen.select("node", "parent", "level", pre.alias("pre"), F.expr("(up - 1 - down) div 2 + 1").alias("size"), "down")
    return nodes.unionByName(_top(seen.agg((F.count("*") + 1).alias("size")), root))


def numbered_edges(edges: DataFrame, root: int) -> DataFrame:
    """numbering() of the tree with these edges (src, dst)."""
    return numbers_of(visits(edges, root), root)


def euler_tour(edges: DataFrame, root: int) -> DataFrame:
    """(src, dst, rank) of both arcs of each tree edge (src, dst), in the order of a tour that leaves root for its smallest neighbour.

    After a -> b comes the arc from b to the neighbour of b that follows a in ascending cyclic order.
    """
    return tour_of(visits(edges, root))


def _top(size: DataFrame, root: int) -> DataFrame:
    return size.select(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("level"), F.lit(1).cast("long").alias("pre"), "size", F.lit(-1).cast("long").alias("down"))


def numbering(tour: DataFrame, root: int) -> DataFrame:
    """(node, parent, level, pre, size, down) of all nodes of a tour: pre from 1, level 0 at the root, down: rank of the arc into the node."""
    tour = saved(tour, "tour")
    back = tour.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("rank").alias("up"))
    down = tour.join(back, ["src", "dst"]).where("rank < up")
    placed = indexed(down, ["rank"], "place")
    pre = (F.col("place") + 2).cast("long")
    nodes = placed.select(F.col("dst").alias("node"), F.col("src").alias("parent"), (2 * pre - 3 - F.col("rank")).alias("level"), pre.alias("pre"), F.expr("(up - 1 - rank) div 2 + 1").alias("size"), F.col("rank").alias("down"))
    return nodes.unionByName(_top(tour.agg((F.expr("count(*) div 2") + 1).alias("size")), root))


def root_of(tree: DataFrame) -> int:
    """The only node without a parent."""
    found = [r["node"] for r in tree.where("parent is null").select("node").limit(2).collect()]
    if len(found) != 1:
        raise ValueError("a tree has exactly one node without a parent")
    return found[0]


def tree_edges(tree: DataFrame) -> DataFrame:
    return tree.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))


def numbered_tree(tree: DataFrame) -> DataFrame:
    """tree: (node, parent). Its numbering."""
    root = root_of(tree)
    return numbered_edges(tree_edges(tree), root)
