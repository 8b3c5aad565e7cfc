"""Arcs, compressed rows, degrees, components and relabelling.

A graph is a DataFrame of arcs (src, dst), both BIGINT; `arc_id` names a stored arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.scan import indexed, prefix_sum
from arbora.plans.shared import derived, saved, stored

from .components import components


def symmetrise(arcs: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """Distinct arcs in both directions."""
    return both_ways(edges_of(arcs, drop_self_loops))


def edges_of(arcs: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """(src, dst): each edge once, its smaller end first."""
    own = arcs.select("src", "dst")
    if drop_self_loops:
        own = own.where("src <> dst")
    turned = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNull())  # null is the largest
    edges = own.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    return edges.toDF("src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst): distinct edges in both directions, self-loops once."""
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.inline(F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))))


def numbered(arcs: DataFrame) -> DataFrame:
    """(arc_id, src, dst): arcs numbered by source, then target, as compressed rows store them."""
    return derived(indexed(arcs.select("src", "dst"), ["src", "dst"], "arc_id").select(F.col("arc_id").cast("long").alias("arc_id"), "src", "dst"))


def degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def to_csr(arcs: DataFrame, n: int) -> DataFrame:
    """(src, offset, degree) for each node 0..n-1, those without arcs too."""
    spark = arcs.sparkSession
    own = spark.range(n).withColumnRenamed("id", "src").join(arcs.groupBy("src").agg(F.count("*").alias("degree")), "src", "left").select("src", F.coalesce("degree", F.lit(0)).alias("degree"))
    return prefix_sum(own, ["src"], "degree", "offset", exclusive=True).select("src", "offset", "degree")


#: Neighbours in one row of adjacency lists.
BLOCK = 1 << 16


def from_csr(rows: DataFrame) -> DataFrame:
    """rows: (src, offset, nbrs). Returns (arc_id, src, dst) in stored order."""
    return rows.select("src", "offset", F.posexplode("nbrs").alias("p", "dst")).select((F.col("offset") + F.col("p")).alias("arc_id"), "src", "dst")


def neighbour_lists(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, offset, degree, nbrs) of the nodes that have arcs. A hub is several rows: arcs are numbered over all nodes, and
    a row ends where that number passes a multiple of `block`, so none holds more neighbours. degree: the row's own."""
    own = numbered(arcs).groupBy("src", F.expr(f"arc_id div {block}").alias("block"))
    lists = own.agg(F.min("arc_id").alias("offset"), F.array_sort(F.collect_list("dst")).alias("nbrs"))
    return lists.select("src", "offset", F.size("nbrs").cast("long").alias("degree"), "nbrs")


def component_sizes(nodes: DataFrame) -> DataFrame:
    """nodes: (node, component)."""
    return nodes.groupBy("component").agg(F.count("*").alias("size"))


def largest_component(arcs: DataFrame, symmetric: bool = False) -> tuple[DataFrame, DataFrame]:
    """Arcs of the largest weak component (ties: the smallest component), self-loops dropped and nodes renamed densely in their old order, and the names (old, new).

    symmetric: arcs are distinct and hold each edge in both directions, so one direction is renamed.
    """
    own = derived(stored(arcs, ["src", "dst"], "arcs").where("src <> dst"))
    comp = saved(components(own if symmetric else symmetrise(own)), "components")
    best = component_sizes(comp).agg(F.max(F.struct("size", (-F.col("component")).alias("c")))["c"].alias("c")).select((-F.col("c")).alias("component"))
    names = indexed(comp.join(F.broadcast(best), "component").select(F.col("node").alias("old")), ["old"], "new").select("old", F.col("new").cast("long").alias("new"))
    names = saved(names, "names")
    out = (own.where("src < dst") if symmetric else own).join(names.toDF("src", "s"), "src").join(names.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return both_ways(out) if symmetric else out, names


def top_degree(arcs: DataFrame) -> int | None:
    """The node of the highest degree, the smallest of several."""
    return degrees(arcs).agg(F.max(F.struct("degree", (-F.col("node")).alias("x")))["x"].alias("x")).select(-F.col("x")).first()[0]


