"""Range minima and maxima over a tree of blocks, in linear space.

Places are stored in rows of `WIDTH` values; a block's least and greatest are a value of the next level, so all levels
together have n / (WIDTH - 1) rows. An interval takes a slice of the blocks at its two ends and goes on with the whole
blocks between them one level up: two joins for each level, of which there are log n / log WIDTH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.plans.shared import saved

#: Values in a row.
WIDTH = 64


def blocks(values: DataFrame, width: int = WIDTH) -> DataFrame:
    """values: (pos, lo, hi). Returns (block, xs): at most `width` values, (pos, lo, hi) in order, for each block."""
    return values.groupBy(F.expr(f"pos div {width}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("xs"))


def levels(values: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """The rows of each level, up to one with one block."""
    out = [saved(blocks(values, width), "rmq-blocks")]
    while not out[-1].where("block > 0").isEmpty():
        up = out[-1].select(F.col("block").alias("pos"), F.array_min(F.col("xs")["lo"]).alias("lo"), F.array_max(F.col("xs")["hi"]).alias("hi"))
        out.append(saved(blocks(up, width), "rmq-blocks"))
    return out


def interval_minmax(values: DataFrame, asked: DataFrame, width: int = WIDTH) -> DataFrame:
    """values: (pos, lo, hi) for each place 0..n-1; asked: (key, first, last). Returns (key, lo, hi): least lo and greatest hi of the places first..last."""
    asked = asked.select("key", F.col("first").cast("long"), F.col("last").cast("long"))
    parts = None
    for level in levels(values.select("pos", "lo", "hi"), width):

        def taken(ends: DataFrame) -> DataFrame:
            """ends: (key, block, a, b): what the places a to b of a block give."""
            xs = F.slice("xs", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a") + 1).cast("int"))
            return ends.join(level, "block").select("key", F.array_min(xs["lo"]).alias("lo"), F.array_max(xs["hi"]).alias("hi"))

        def block(c: str) -> Column:
            return F.expr(f"{c} div {width}")

        own = asked.where("first <= last").select("key", "first", "last", block("first").alias("x"), block("last").alias("y"))
        left = own.select("key", F.col("x").alias("block"), F.expr(f"first % {width}").alias("a"), F.when(F.col("x") == F.col("y"), F.expr(f"last % {width}")).otherwise(width - 1).alias("b"))
        right = own.where("x < y").select("key", F.col("y").alias("block"), F.lit(0).alias("a"), F.expr(f"last % {width}").alias("b"))
        both = taken(left.unionByName(right))
        parts = both if parts is None else parts.unionByName(both)
        asked = own.where("y - x > 1").select("key", (F.col("x") + 1).alias("first"), (F.col("y") - 1).alias("last"))
    return parts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
