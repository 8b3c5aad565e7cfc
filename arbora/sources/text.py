"""Text formats: road networks (`p sp`, `a s d w`), matrix market, edge lists with a `# Nodes:` header, plain numbers.

Malformed lines, wrong counts and nodes out of range raise BadFile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.graph import symmetrise
from arbora.plans.scan import indexed
from arbora.plans.shared import saved

from .binary import BadFile, _first, _slice, csr_arcs, length, tree_of


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the lines of a file with their byte offsets."""
    length(spark, path)
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return saved(spark.createDataFrame(rows, "at long, line string"), "lines")


def _fields(rows: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Numbers of lines that match the pattern; any other line is an error."""
    bad = rows.where(~F.col("line").rlike(pattern)).limit(1).collect()
    if bad:
        raise BadFile(f"malformed line: {bad[0]['line'][:80]!r}")
    return rows.select(*[F.regexp_extract("line", pattern, i + 1).cast("long").alias(n) for i, n in enumerate(names)])


def _checked(arcs: DataFrame, n: int, m: int, first: int) -> DataFrame:
    arcs = saved(arcs, "arcs")
    found, low, high = arcs.agg(F.count("*"), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if found != m or found and (low < first or high >= n + first):
        raise BadFile(f"{found} arcs between {low} and {high} in a file of {n} nodes and {m} arcs")
    return arcs.withColumn("src", F.col("src") - first).withColumn("dst", F.col("dst") - first)


def read_dimacs(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(n, arcs): arcs (src, dst, weight) from 0, as stored."""
    rows = lines(spark, path)
    top = rows.orderBy("at").first()
    head = rows.where(F.col("line").rlike(r"^p\s")).limit(2).collect()
    if top is None or "DIMACS" not in top["line"] or len(head) != 1:
        raise BadFile(f"{path}: not a road network")
    n, m = _fields(rows.where(F.col("line").rlike(r"^p\s")), r"^p\s+sp\s+(\d+)\s+(\d+)\s*$", ["n", "m"]).first()
    body = rows.where(~F.col("line").rlike(r"^(c|p\s|\s*$)"))
    return n, _checked(_fields(body, r"^a\s+(\d+)\s+(\d+)\s+(-?\d+)\s*$", ["src", "dst", "weight"]), n, m, 1)


def read_matrix_market(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(n, arcs): distinct arcs in both directions from 0, with weights if the entries are integers."""
    rows = lines(spark, path)
    top = rows.orderBy("at").first()
    kind = top and top["line"].split()
    if not kind or kind[:3] != ["%%MatrixMarket", "matrix", "coordinate"] or len(kind) != 5 or kind[3] not in ("pattern", "integer") or kind[4] not in ("general", "symmetric"):
        raise BadFile(f"{path}: not a pattern or integer coordinate matrix")
    body = rows.where(~F.col("line").rlike(r"^(%|\s*$)"))
    head = body.orderBy("at").first()
    if head is None:
        raise BadFile(f"{path}: no sizes")
    size = body.where(F.col("at") == head["at"])
    n, columns, m = _fields(size, r"^\s*(\d+)\s+(\d+)\s+(\d+)\s*$", ["n", "c", "m"]).first()
    if n != columns:
        raise BadFile(f"{path}: the matrix isn't square")
    weighted = kind[3] == "integer"
    pattern, names = (r"^\s*(\d+)\s+(\d+)\s+(-?\d+)\s*$", ["src", "dst", "weight"]) if weighted else (r"^\s*(\d+)\s+(\d+)\s*$", ["src", "dst"])
    arcs = _checked(_fields(body.where(F.col("at") != head["at"]), pattern, names), n, m, 1)
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *names[2:])
    return n, arcs.unionByName(back).distinct()


def read_snap(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(n, arcs): distinct arcs in both directions; nodes are below n."""
    rows = lines(spark, path)
    pattern = r"^#\s*Nodes:\s*(\d+)\s+Edges:\s*(\d+)"
    head = rows.where(F.col("line").rlike(pattern)).limit(2).collect()
    if len(head) != 1:
        raise BadFile(f"{path}: no line with the numbers of nodes and edges")
    n, m = _fields(rows.where(F.col("line").rlike(pattern)), pattern, ["n", "m"]).first()
    body = rows.where(~F.col("line").rlike(r"^(#|\s*$)"))
    return n, symmetrise(_checked(_fields(body, r"^\s*(\d+)\s+(\d+)\s*$", ["src", "dst"]), n, m, 0))


def _plain(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(at, value) of whitespace-separated numbers, and how many there are."""
    words = lines(spark, path).select("at", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("p", "w")).where("w <> ''")
    if not words.where(~F.col("w").rlike(r"^-?\d+$")).isEmpty():
        raise BadFile(f"{path}: not only numbers")
    rows = indexed(words.withColumnRenamed("at", "byte"), ["byte", "p"], "at").select(F.col("at").cast("long").alias("at"), F.col("w").cast("long").alias("value"))
    rows = saved(rows, "numbers")
    return rows, rows.count()


def read_graph_text(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(n, arcs) of n, m, offsets and columns as text."""
    rows, size = _plain(spark, path)
    n, m = _first(rows, 0, 1)
    if size == 2 + n + m:  # the last offset may be left out
        rows = rows.withColumn("at", F.when(F.col("at") >= 2 + n, F.col("at") + 1).otherwise(F.col("at"))).unionByName(spark.createDataFrame([(2 + n, m)], "at long, value long"))
    elif size != 3 + n + m:
        raise BadFile(f"{path}: {size} numbers don't hold a graph of {n} nodes and {m} arcs")
    return n, csr_arcs(n, m, _slice(rows, 2, n + 1), _slice(rows, 3 + n, m))


def read_tree_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tree, queries) of V, root, parents, Q and pairs as text."""
    return tree_of(*_plain(spark, path))


def write_answers_text(answers: DataFrame, path: str) -> None:
    """One answer for each line, by qid: a folder of text files in order."""
    answers.select("qid", F.col("lca").cast("string").alias("value")).orderBy("qid").select("value").write.text(path)
