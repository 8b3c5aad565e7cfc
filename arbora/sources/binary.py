"""Little-endian int32 files: compressed-row graphs, trees with queries, answers.

graph: n, m, offsets[n + 1], columns[m], then weights[m] or nothing. tree with queries: V, root, parents[V], Q, pairs[2Q].
answers: values[Q]. Files are read through Hadoop's file system in records that tasks share out, so they can lie in any
store that Spark reads and no task holds a whole file. A single output file is streamed by the driver in chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.graph import to_csr
from arbora.plans.scan import indexed
from arbora.plans.shared import saved

#: Numbers that a record of an input file, or a chunk of an output file, holds at most.
RECORD = 1 << 14


class BadFile(ValueError):
    """A file that is missing, cut short or contradicts itself."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def length(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise BadFile(f"{path}: no such file")
    return fs.getFileStatus(p).getLen()


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the numbers of a file with their places."""
    size = length(spark, path)
    if size % 4 or not size:
        raise BadFile(f"{path}: {size} bytes aren't whole numbers")
    record = max(d for d in range(1, RECORD + 1) if size // 4 % d == 0)
    conf = {"fixedlengthinputformat.record.length": str(4 * record)}
    raw = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def decode(batches):
        for pdf in batches:
            for start, data in zip(pdf["start"], pdf["data"], strict=True):
                values = np.frombuffer(bytes(data), "<i4").astype(np.int64)
                yield pd.DataFrame({"at": start // 4 + np.arange(len(values)), "value": values})

    return spark.createDataFrame(raw.map(lambda r: (r[0], bytearray(r[1]))), "start long, data binary").mapInPandas(decode, "at long, value long")


def _first(rows: DataFrame, *places: int) -> list[int]:
    got = {r["at"]: r["value"] for r in rows.where(F.col("at").isin(*places)).collect()}
    if len(got) != len(places):
        raise BadFile("the file is cut short")
    return [got[p] for p in places]


def expanded(rows: DataFrame) -> DataFrame:
    """rows: (src, offset, degree). (src, at) for each arc's place, a hub's in blocks."""
    step = 1 << 16
    blocks = rows.where("degree > 0").select("src", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("degree") - 1, F.lit(step).cast("long"))).alias("b"), (F.col("offset") + F.col("degree")).alias("end"))
    return blocks.select("src", F.explode(F.sequence("b", F.least(F.col("b") + step, "end") - 1)).alias("at"))


def csr_arcs(n: int, m: int, offsets: DataFrame, columns: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(arc_id, src, dst, weight) from offsets (at, value), n + 1 of them, and columns and weights (at, value); weight is null without weights."""
    after = offsets.select((F.col("at") - 1).alias("at"), F.col("value").alias("end"))
    rows = offsets.where(F.col("at") < n).join(after, "at").select(F.col("at").alias("src"), F.col("value").alias("offset"), (F.col("end") - F.col("value")).alias("degree"))
    wrong = rows.where((F.col("degree") < 0) | (F.col("offset") < 0)).isEmpty() and columns.where((F.col("value") < 0) | (F.col("value") >= n)).isEmpty()
    total = rows.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    if not wrong or total != m or columns.count() != m or rows.count() != n:
        raise BadFile("offsets and columns don't make a graph")
    out = expanded(rows).join(columns.select("at", F.col("value").alias("dst")), "at")
    if weights is None:
        return out.select(F.col("at").alias("arc_id"), "src", "dst", F.lit(None).cast("long").alias("weight"))
    return out.join(weights.select("at", F.col("value").alias("weight")), "at", "left").select(F.col("at").alias("arc_id"), "src", "dst", "weight")


def _slice(rows: DataFrame, first: int, count: int) -> DataFrame:
    return rows.where((F.col("at") >= first) & (F.col("at") < first + count)).select((F.col("at") - first).alias("at"), "value")


def read_graph(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(n, arcs) of a compressed-row file; weights may be missing altogether, not in part."""
    rows = saved(numbers(spark, path), "numbers")
    n, m = _first(rows, 0, 1)
    size = length(spark, path) // 4
    if n < 0 or m < 0 or size not in (3 + n + m, 3 + n + 2 * m):
        raise BadFile(f"{path}: {size} numbers don't hold a graph of {n} nodes and {m} arcs")
    weights = _slice(rows, 3 + n + m, m) if size > 3 + n + m else None
    return n, csr_arcs(n, m, _slice(rows, 2, n + 1), _slice(rows, 3 + n, m), weights)


def tree_of(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(tree, queries) from numbers: V, root, parents, Q, pairs."""
    v, root = _first(rows, 0, 1)
    (q,) = _first(rows, 2 + v)
    if v < 1 or q < 0 or size != 3 + v + 2 * q:
        raise BadFile(f"{size} numbers don't hold a tree of {v} nodes and {q} queries")
    tree = _slice(rows, 2, v).select(F.col("at").alias("node"), F.when(F.col("value") != -1, F.col("value")).alias("parent"))
    tops = [r["node"] for r in tree.where("parent is null").limit(2).collect()]
    if tops != [root]:
        raise BadFile(f"the root {root} isn't the only node without a parent")
    pairs = _slice(rows, 3 + v, 2 * q).select(F.expr("at div 2").alias("qid"), (F.col("at") % 2).alias("side"), "value")
    queries = pairs.where("side = 0").select("qid", F.col("value").alias("x")).join(pairs.where("side = 1").select("qid", F.col("value").alias("y")), "qid")
    return tree, queries


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tree, queries) of a test file."""
    return tree_of(saved(numbers(spark, path), "numbers"), length(spark, path) // 4)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return numbers(spark, path).select(F.col("at").alias("qid"), F.col("value").alias("lca"))


def write_numbers(parts: list[list[int] | DataFrame], path: str, spark: SparkSession) -> None:
    """One file of the parts in order: lists of numbers, or (at, value) with places from 0."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        for part in parts:
            if isinstance(part, list):
                out.write(bytearray(np.array(part, "<i4").tobytes()))
                continue
            chunks = part.groupBy(F.expr(f"at div {RECORD}").alias("c")).agg(F.sort_array(F.collect_list(F.struct("at", "value")))["value"].alias("v")).orderBy("c")
            for r in chunks.toLocalIterator():
                out.write(bytearray(np.array(r["v"], "<i4").tobytes()))
    finally:
        out.close()


def write_graph(arcs: DataFrame, n: int, path: str) -> None:
    """arcs: (src, dst) or (src, dst, weight), stored by source, then target."""
    spark = arcs.sparkSession
    extra = [c for c in ("weight",) if c in arcs.columns]
    own = saved(indexed(arcs.select("src", "dst", *extra), ["src", "dst", *extra], "at"), "numbered")
    m = own.count()
    offsets = to_csr(own, n).select(F.col("src").alias("at"), F.col("offset").alias("value"))
    weights = [own.select("at", F.col("weight").alias("value"))] if extra else []
    write_numbers([[n, m], offsets, [m], own.select("at", F.col("dst").alias("value")), *weights], path, spark)


def write_tree(tree: DataFrame, queries: DataFrame, path: str) -> None:
    """tree on nodes 0..V-1; queries by qid from 0."""
    spark = tree.sparkSession
    root = tree.where("parent is null").first()["node"]
    pairs = queries.select((2 * F.col("qid")).alias("at"), F.col("x").alias("value")).unionByName(queries.select((2 * F.col("qid") + 1).alias("at"), F.col("y").alias("value")))
    write_numbers([[tree.count(), root], tree.select(F.col("node").alias("at"), F.coalesce("parent", F.lit(-1)).alias("value")), [queries.count()], pairs], path, spark)


def write_answers(answers: DataFrame, path: str) -> None:
    write_numbers([answers.select(F.col("qid").alias("at"), F.col("lca").alias("value"))], path, answers.sparkSession)
