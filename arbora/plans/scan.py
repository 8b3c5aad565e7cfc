"""Global order without a single-task window: row numbers and prefix sums in two levels.

Rows are dealt to range partitions and sorted there; each task counts and sums as its rows stream by, and the partitions'
totals (a row for each) give each partition's start. A hot key's
rows spread over partitions as any others do, since the order columns tell them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import derived, saved


def placed(df: DataFrame, order: Sequence[str | Column], value: str | None = None) -> DataFrame:
    """Adds _place (from 0, in the order of columns that tell all rows apart; else ties are numbered at random) and _upto, the sum of
    the whole numbers `value` up to the row (without value: the place from 1). Rows are shuffled and sorted once and stored."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if value is None:  # the id holds the partition and the row's number in it
        at = F.monotonically_increasing_id()
        own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        spread = saved(dealt.withColumn("_at", at).select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_part"), own.alias("_own"), own.alias("_sum")), "scan")
    else:
        spread = saved(dealt.mapInArrow(_summed(value), StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_own", LongType()), StructField("_sum", LongType())])), "scan")
    rows, total, before, sums = 0, 0, [0], [0]
    for r in sorted(spread.groupBy("_part").agg(F.max("_own").alias("n"), F.max_by("_sum", "_own").alias("s")).collect()):  # a row for each partition
        short = r["_part"] + 1 - len(before)  # partitions without rows
        before, sums = before + [rows] * short, sums + [total] * short
        before[r["_part"]], sums[r["_part"]] = rows, total
        rows, total = rows + r["n"], total + r["s"]
    starts, totals = (F.get(F.lit(x).cast("array<long>"), F.col("_part")) for x in (before, sums))
    return derived(spread.select(*df.columns, (F.col("_own") + starts - 1).alias("_place"), (F.col("_sum") + totals).alias("_upto")))


def _summed(value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the partition's number, the row's number in it and the sum of `value` up to the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            own = np.arange(at + 1, at + b.num_rows + 1, dtype=np.int64)
            upto = total + np.cumsum(pc.fill_null(b.column(value).cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
            if b.num_rows:
                at, total = int(own[-1]), int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(own), pa.array(upto)], names=[*b.schema.names, "_part", "_own", "_sum"])

    return run


def indexed(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds the row's place, from 0, in the order of columns that tell all rows apart (else ties are numbered at random)."""
    return placed(df, order).drop("_upto").withColumnRenamed("_place", name)


def prefix_sum(df: DataFrame, order: Sequence[str | Column], value: str, name: str, exclusive: bool = False) -> DataFrame:
    """Adds the sum of the whole numbers `value` over the rows up to this one in order (without it, if exclusive)."""
    out = placed(df, order, value)
    return out.withColumn(name, F.col("_upto") - (F.coalesce(value, F.lit(0)) if exclusive else F.lit(0))).drop("_place", "_upto")
