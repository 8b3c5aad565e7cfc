"""Mixing sources to target weights by the cube method.

Sources, ordered by code point (null last), have the weights `weights`, repeating. They share `budget` times the words
of all texts by weight; a target stops at `most` times its source's size and the excess is shared out again by weight
until none is above. Each document is taken floor(r) times and once more with probability r - floor(r), where r is its
source's target over its size. Which documents are taken once more is a balanced sample within each source:

* Flight: inclusion probabilities move along a vector in the null space of the balancing constraints (numbers of words
  and of documents), at random to one of the two ends where a probability becomes 0 or 1, so that each step settles a
  document and keeps both totals. Blocks of `block` documents do this side by side; of each block at most two
  documents remain, which form the blocks of the next level. `reserve` documents of each source wait for its last block.
* Landing: the last two documents or so of a source take the outcome that comes closest to the word total. What that
  misses (such documents are mostly long) is made good by turning settled documents of the last block, one after another.

Sizes are numbers of `[^\\x20\\x09-\\x0D]+` in the text. Draws depend on `seed`, sources, sizes and ids (null ids: the row's
place) alone, so reruns agree. Defined cases: null texts have size 0; documents of size 0 are taken 0 words; a null source is a source of its
own; a source of size 0 has target 0; repeated rows are documents of their own; without any words all targets are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    most: int = 2
    block: int = 4096
    reserve: int = 256
    seed: int = 41


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, deal) of each row. deal: the id's hash; rows with a null id are spread by their place."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    deal = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.cast("long").alias("size"), deal.alias("deal"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, by code point with null last: ranks within range partitions plus the sizes of those before."""
    spread = common.saved(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for r in spread.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    start = F.broadcast(spread.sparkSession.createDataFrame(offsets, "part int, start long"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return spread.join(start, "part").withColumn("rank", own + F.col("start") - 1).drop("part", "start")


def allocated(sources: DataFrame, p: MixParams) -> DataFrame:
    """sources: (source, source_size). Adds rank, weight and target."""
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.col("rank") % len(p.weights) + 1).cast("int"))
    own = common.saved(ranked(sources).withColumn("weight", weight.cast("long")), "allocation")
    total = own.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * p.budget
    top = F.col("source_size") * p.most
    own, known, share = own.withColumn("capped", F.lit(0).cast("long")), -1, F.lit(0.0)
    while True:  # each round caps at least one more source
        full, weight, n = own.agg(F.coalesce(F.sum(top * F.col("capped")), F.lit(0)), F.coalesce(F.sum(F.col("weight") * (1 - F.col("capped"))), F.lit(0)), F.coalesce(F.sum("capped"), F.lit(0))).first()
        if n == known or not weight:
            break
        known, share = n, F.lit(float(total - full)) * F.col("weight") / F.lit(float(weight))
        own = common.saved(own.withColumn("capped", F.when((F.col("capped") == 1) | (share > top), 1).otherwise(0).cast("long")), "allocation")
    own = own.withColumn("target", F.when(F.col("capped") == 1, top.cast("double")).otherwise(share))
    return own.select("source", "source_size", "rank", "weight", "target")


# --- the cube method on one block ------------------------------------------------------------


def flight(size: list[int], prob: list[float], rng: np.random.Generator) -> list[float]:
    """Moves the probabilities until at most two lie between 0 and 1, keeping their sum and their sum weighted by size."""
    prob, eps = list(prob), 1e-9
    waiting = iter([i for i, x in enumerate(prob) if eps < x < 1 - eps])
    live: list[int] = []
    draws = iter(rng.random(2 * len(prob) + 8).tolist())
    while True:
        while len(live) < 3 and (i := next(waiting, None)) is not None:
            live.append(i)
        if len(live) == 3:
            a, b, c = (size[i] for i in live)
            u = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the sizes
            if u == (0, 0, 0):
                u = (1, -1, 0)
        elif len(live) == 2 and size[live[0]] == size[live[1]]:
            u = (1, -1)
        else:
            return prob
        up = min((1 - prob[i]) / x if x > 0 else -prob[i] / x for i, x in zip(live, u, strict=True) if x)
        down = min(prob[i] / x if x > 0 else (prob[i] - 1) / x for i, x in zip(live, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(live, u, strict=True):
            prob[i] += step * x
        live = [i for i in live if eps < prob[i] < 1 - eps]


def landing(size: list[int], prob: list[float]) -> list[float]:
    """Settles the few probabilities that are left: the outcome whose words, then documents, come closest to what is expected."""
    left = [i for i, x in enumerate(prob) if 1e-9 < x < 1 - 1e-9]
    words, docs = sum(size[i] * prob[i] for i in left), sum(prob[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (round(abs(sum(size[i] for k, i in enumerate(left) if m >> k & 1) - words), 6), abs(m.bit_count() - docs), m))
    out = [float(round(x)) for x in prob]
    for k, i in enumerate(left):
        out[i] = float(best >> k & 1)
    return out


def repaired(size: list[int], settled: list[float], missed: float) -> list[float]:
    """Turns settled units while that brings the missed words (those taken less those expected) closer to 0."""
    out, sizes = np.array(settled), np.array(size, float)
    for _ in size:
        after = missed + np.where(out == 0, sizes, -sizes)
        best = int(np.abs(after).argmin()) if len(after) else -1
        if best < 0 or abs(after[best]) >= abs(missed) - 1e-6:
            break
        missed, out[best] = after[best], 1 - out[best]
    return out.tolist()


def _settle(units: DataFrame, p: MixParams, level: int) -> DataFrame:
    """units: (rank, id, deal, size, prob, held, block, blocks). Probabilities after a flight in each block; a source's only block lands too. Ids stay in Arrow."""
    names = ["rank", "id", "deal", "size", "prob", "held"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rank, block = (x.as_py() for x in key)
        table = table.sort_by([("size", "descending"), ("deal", "ascending"), ("prob", "ascending")])
        size, given = table.column("size").to_pylist(), table.column("prob").to_pylist()
        prob = flight(size, given, np.random.default_rng([p.seed, level, rank, block]))
        if table.column("blocks")[0].as_py() == 1:
            prob = landing(size, prob)
            prob = repaired(size, prob, sum(s * (x - y) for s, x, y in zip(size, prob, given, strict=True)))
        prob = pa.array([float(round(x)) if min(x, 1 - x) < 1e-9 else x for x in prob])
        return table.select(names).set_column(4, "prob", prob)

    return units.groupBy("rank", "block").applyInArrow(run, units.select(names).schema)


def balanced(units: DataFrame, p: MixParams) -> DataFrame:
    """units: (rank, id, deal, size, prob), settled to probabilities 0 and 1. deal: what tells them apart."""
    done, level = units.where("prob <= 0 or prob >= 1").withColumn("held", F.lit(False)), 0
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64("deal", F.lit(p.seed)), "deal"))
    units = units.where("prob > 0 and prob < 1")
    last = units.select("rank", "deal", place.alias("place")).where(F.col("place") <= p.reserve).select("rank", "deal", F.lit(True).alias("held")).distinct()
    units = common.saved(units.join(last, ["rank", "deal"], "left").select("rank", "id", "deal", "size", "prob", F.coalesce("held", F.lit(False)).alias("held")), "mix")
    while True:
        n = units.groupBy("rank").agg(F.greatest(F.lit(1), F.ceil(F.sum(1 - F.col("held").cast("int")) / p.block)).cast("int").alias("blocks"))
        dealt = units.join(n, "rank").withColumn("block", F.pmod(F.xxhash64("deal", F.lit(p.seed + 7 * level + 1)), "blocks").cast("int"))
        settled = _settle(dealt.where("blocks = 1 or not held"), p, level)
        settled = common.saved(settled.unionByName(dealt.where("blocks > 1 and held").select(settled.columns)), "mix")
        done = done.unionByName(settled.where("prob = 0 or prob = 1"))
        units = settled.where("prob > 0 and prob < 1")
        level += 1
        if units.isEmpty():
            return done.drop("held")


def mix(docs: DataFrame, p: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, taken) for each row of docs; other columns aren't read."""
    own = common.saved(sizes(docs, id_col, text_col, source_col), "sizes")
    sources = common.saved(allocated(own.groupBy("source").agg(F.sum("size").alias("source_size")), p), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = own.join(sources.select(F.col("source").alias("s"), "rank", ratio.alias("ratio")), F.col("source").eqNullSafe(F.col("s")))
    prob = F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0)
    out = balanced(rows.select("rank", "id", "deal", "size", prob.alias("prob")), p)
    out = out.join(sources.withColumn("whole", F.floor(ratio)), "rank")
    taken = F.col("size") * (F.col("whole") + F.round("prob").cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
