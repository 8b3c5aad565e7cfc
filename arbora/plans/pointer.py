"""Pointer jumping: list ranking and jumps to roots in a logarithmic number of rounds.

A round is three joins with the table of all pointers and takes each pointer that is still under way four times as far;
those that have arrived aren't written again. Long lists are contracted first: every pointer runs to the next of the
randomly chosen splitters, one node in `every`, the splitters are ranked as a shorter weighted list, and what stands
between them takes its place from the splitter that it ran to. All lists together hold about n * every / (every - 1)
rows, and each is written a few times, where plain jumping writes a list once for each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, unbroadcast

#: One node of a list in so many is a splitter.
EVERY = 8
#: Shorter lists have so few rounds that contraction would only add some.
SHORT = 1 << 20


def _run(links: DataFrame, stop: Callable[[Column], Column] | None = None) -> DataFrame:
    """links: (id, to, w), `to` null at ends, stored. Moves each pointer to the first stop on its way, or the end: (id, to, w), w summed up."""
    arrived = F.col("to").isNull() if stop is None else F.col("to").isNull() | stop(F.col("to"))
    first = links.select("id", "to", "w", (~arrived).alias("under_way"))
    done, now, n = [first.where("not under_way")], first.where("under_way"), links.count()
    while not now.isEmpty():
        table = now
        for x in done:
            table = table.unionByName(x)
        table = unbroadcast(table.toDF("at", "to2", "w2", "more"), n)
        step = now
        for _ in range(3):
            key = F.when(F.col("under_way"), F.col("to")).otherwise(F.col("id"))  # those that have arrived match themselves, in vain
            go = F.col("under_way") & F.col("to2").isNotNull()
            moved = step.withColumn("at", key).join(table, "at", "left")
            step = moved.select("id", F.when(go, F.col("to2")).otherwise(F.col("to")).alias("to"), (F.col("w") + F.when(go, F.col("w2")).otherwise(0)).alias("w"), (go & F.col("more")).alias("under_way"))
        new = saved(step, "pointers")
        done.append(new.where("not under_way"))
        now = new.where("under_way")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("id", "to", "w")


def _left(links: DataFrame, every: int, short: int, level: int = 0) -> DataFrame:
    """(id, w): the sum of w from each node to the tail, whose w is 0."""
    n = links.count()
    if n <= short:
        return _run(links).select("id", "w")

    tail = links.where("to is null").select("id").first()["id"]

    def splitter(node: Column) -> Column:
        return (F.pmod(F.xxhash64(node, F.lit(level)), F.lit(every)) == 0) | (node == tail)

    near = _run(links, splitter)
    few = saved(near.where(splitter(F.col("id"))), "splitters")
    if few.count() == n:
        return _run(links).select("id", "w")
    after = saved(_left(few, every, short, level + 1), "splitters").toDF("to", "more")
    return near.join(after, "to", "left").select("id", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))


def sums_to_tail(links: DataFrame, every: int = EVERY, short: int = SHORT) -> DataFrame:
    """links: (id, to, w), a list's, `to` null and w 0 at the tail, stored. Returns (id, w): the sum of w from each node to the tail."""
    return _left(links, every, short)


def list_rank(links: DataFrame, head: int | None = None, every: int = EVERY, short: int = SHORT) -> DataFrame:
    """links: (id, next), next null at the tail, stored. Returns (id, rank): hops from the head.

    With `head` a circular list is cut before it. Ids that the head doesn't reach are undefined input. Lists of more
    than `short` nodes are contracted.
    """
    links = links.select(F.col("id").cast("long"), F.col("next").cast("long"))
    if head is not None:
        links = links.withColumn("next", F.when(F.col("next") == head, F.lit(None)).otherwise(F.col("next")))
    links = links.select("id", F.col("next").alias("to"), F.col("next").isNotNull().cast("long").alias("w"))
    return _left(links, every, short).select("id", (F.lit(links.count() - 1) - F.col("w")).alias("rank"))


def roots(parents: DataFrame) -> DataFrame:
    """parents: (node, parent), parent null at roots (which may also have no row), stored. Returns (node, root, level): level counts hops to the root."""
    links = parents.select(F.col("node").cast("long").alias("id"), F.col("parent").cast("long").alias("to"), F.col("parent").isNotNull().cast("long").alias("w"))
    inner = saved(links.where("to is not null").select(F.col("to").alias("id")).distinct(), "inner").withColumn("inner", F.lit(True))
    links = saved(links.join(inner, "id", "left"), "links")
    tops = saved(_run(links.where("inner").select("id", "to", "w")), "roots")
    leaves = links.where("inner is null").join(tops.toDF("to", "far", "more"), "to", "left")  # nothing points to them, so they take their parent's way
    leaves = leaves.select("id", F.coalesce("far", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    return tops.unionByName(leaves).select(F.col("id").alias("node"), F.coalesce("to", "id").alias("root"), F.col("w").alias("level"))
