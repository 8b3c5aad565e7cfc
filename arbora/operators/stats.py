"""Statistics of trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.shared import saved

from .bfs import diameter_bounds
from .bridges import bridge_count, bridges


def height(nodes: DataFrame) -> DataFrame:
    """(max_height, avg_height) with the root at height 1. nodes: (node, level)."""
    return nodes.agg((F.max("level") + 1).alias("max_height"), (F.sum("level") / F.count("*") + 1).alias("avg_height"))


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"))


def max_distance(found: DataFrame) -> DataFrame:
    return found.agg(F.max("distance").alias("max_distance"))


def graph_stats(arcs: DataFrame, strategy: str = "auto") -> DataFrame:
    """One row (n, m, bridges, diam_lb, diam_ub): nodes, stored arcs, bridge arcs, bounds of the diameter."""
    arcs = saved(arcs.select("src", "dst"), "graph")
    lower, upper = diameter_bounds(arcs)
    size = arcs.agg(F.count("*").alias("m")).crossJoin(arcs.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("n")))
    return size.crossJoin(bridge_count(bridges(arcs, strategy))).select("n", "m", "bridges", F.lit(lower).cast("long").alias("diam_lb"), F.lit(upper).cast("long").alias("diam_ub"))
