"""Random trees and queries as pure functions of node numbers and a seed: reruns and partitions don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.plans.pointer import roots
from arbora.plans.scan import indexed
from arbora.plans.shared import saved

#: Knuth's multiplicative constant.
KNUTH = 2654435761


def below(n: Column, *salt: Column) -> Column:
    """A number from 0 to n - 1 that depends on the salts."""
    return F.pmod(F.xxhash64(*salt), n)


def simple_tree(spark: SparkSession, n: int, grasp: int = -1, seed: int = 1) -> DataFrame:
    """(node, parent): node i hangs under one of the `grasp` nodes before it, evenly; -1: under any node before it."""
    i = F.col("node")
    width = i if grasp < 0 else F.least(i, F.lit(grasp))
    return spark.range(n).withColumnRenamed("id", "node").select("node", F.when(i > 0, i - 1 - below(width, i, F.lit(seed))).alias("parent"))


def grasp_tree(order: DataFrame, grasp: int) -> DataFrame:
    """(node, parent) from numbered keys (i, key): parent = i - 1 - ((key * KNUTH + i) mod w), w = i, or at most grasp."""
    i = F.col("i")
    width = i if grasp < 0 else F.least(i, F.lit(grasp))
    return order.select(i.alias("node"), F.when(i > 0, i - 1 - F.pmod(F.col("key") * KNUTH + i, width)).alias("parent"))


def scale_free_tree(order: DataFrame) -> DataFrame:
    """(node, parent) from numbered keys (i, key), i from 0: a parent is taken in proportion to its degree.

    Edge e (joining node e + 1 to its parent) copies an end of the edges before it, number (key * KNUTH + e) mod 2e of
    them: end 2k is node k + 1 itself, end 2k + 1 is the parent of node k + 1, which is followed by pointer jumping. Edge
    0 joins nodes 1 and 0.
    """
    e = F.col("i") - 1
    end = F.when(e > 0, F.pmod(F.col("key") * KNUTH + e, 2 * e))
    picks = order.where("i > 0").select(e.alias("node"), end.alias("end"))
    own = F.when(F.col("node") == 0, 0).when(F.col("end") % 2 == 0, F.expr("end div 2 + 1")).cast("long")
    picks = saved(picks.select("node", F.when(F.col("end") % 2 == 1, F.expr("end div 2")).alias("parent"), own.alias("own")), "picks")
    top = roots(picks.select("node", "parent")).select("node", F.col("root").alias("r"))
    ends = top.join(picks.select(F.col("node").alias("r"), "own"), "r").select((F.col("node") + 1).alias("node"), F.col("own").alias("parent"))
    return ends.unionByName(order.where("i = 0").select(F.col("i").alias("node"), F.lit(None).cast("long").alias("parent")))


def shuffled(tree: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The tree under a random renaming of its nodes 0..n-1, and the names (old, new)."""
    names = indexed(tree.select(F.col("node").alias("old"), F.xxhash64("node", F.lit(seed)).alias("h")), ["h", "old"], "new").select("old", F.col("new").cast("long").alias("new"))
    return renamed(tree, names), names


def renamed(tree: DataFrame, names: DataFrame) -> DataFrame:
    up = names.select(F.col("old").alias("parent"), F.col("new").alias("p"))
    return tree.join(names.select(F.col("old").alias("node"), F.col("new").alias("n")), "node").join(up, "parent", "left").select(F.col("n").alias("node"), F.col("p").alias("parent"))


def random_queries(spark: SparkSession, n: int, count: int, seed: int = 1) -> DataFrame:
    """(qid, x, y) of uniform node pairs."""
    q = F.col("qid")
    return spark.range(count).withColumnRenamed("id", "qid").select("qid", below(F.lit(n), q, F.lit(seed), F.lit(0)).alias("x"), below(F.lit(n), q, F.lit(seed), F.lit(1)).alias("y"))
