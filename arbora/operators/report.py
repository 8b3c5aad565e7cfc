"""Benchmark reports: runner logs to timings, means and deviations over runs, filters and throughputs.

A log is cases: `%%% problem: File: name` (or `%%% file: name`) opens one and a blank line ends it, `%%% key: value` lines before and after
the timings are its headers, and `algo: phase: x ms.` lines are its timings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, line_no, line) of the text files at path; run: the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("run"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return lines


def parse_timings(lines: DataFrame) -> DataFrame:
    """lines: (run, line_no, line). (run, case_no, headers, algo, phase, value): a row for each timing; headers: a map of
    its case's headers, with `problem` and `File` from the line that opens it, wherever in the case they stand.

    One log is one window: logs are what one runner printed.
    """
    by = Window.partitionBy("run").orderBy("line_no")
    turn = (F.trim("line") == "") | F.col("line").rlike(r"^%%%\s*(?:[^:]+:\s*)?[Ff]ile\s*:")
    rows = lines.withColumn("case_no", F.sum(turn.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.trim("line") != "")
    opening, header = r"^%%%\s*([^:]+?)\s*:\s*File\s*:\s*(.*?)\s*$", r"^%%%\s*([^:]+?)\s*:\s*(.*?)\s*$"

    def pair(key, value):
        return F.struct(key.alias("k"), value.alias("v"))

    def part(pattern, at):
        return F.regexp_extract("line", pattern, at)

    own = F.when(F.col("line").rlike(opening), F.array(pair(F.lit("problem"), part(opening, 1)), pair(F.lit("File"), part(opening, 2))))
    own = own.when(F.col("line").rlike(header), F.array(pair(part(header, 1), part(header, 2))))
    heads = rows.select("run", "case_no", "line_no", F.explode(own).alias("h")).groupBy("run", "case_no", "h.k").agg(F.max(F.struct("line_no", "h.v"))["v"].alias("v"))
    headers = heads.groupBy("run", "case_no").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("headers"))
    timing = r"^\s*([^:%]+?)\s*:\s*([^:]+?)\s*:\s*([0-9.eE+-]+)\s*(?:ms)?\.?\s*$"
    found = rows.where(F.col("line").rlike(timing) & ~F.col("line").startswith("%%%"))
    return found.select("run", "case_no", part(timing, 1).alias("algo"), part(timing, 2).alias("phase"), F.rtrim(part(timing, 3), F.lit(".")).cast("double").alias("value")).join(headers, ["run", "case_no"], "left")


def name_fields(name: str, fields: tuple[str, ...] = ("V", "Q", "grasp", "batch")):
    """Columns of the numbers in a test file's name: `key_value` parts joined by # behind a $; null where there's none."""
    found = [F.regexp_extract(name, rf"\$(?:.*#)?{k}_(-?[0-9]+)(?:[#.]|$)", 1) for k in fields]
    return [F.when(x != "", x).cast("long").alias(k) for x, k in zip(found, fields, strict=True)]


def wide(timings: DataFrame, keys: list[str], phases: list[str] | None = None) -> DataFrame:
    """A column for each phase."""
    return timings.groupBy(*keys).pivot("phase", phases).agg(F.sum("value")) if phases else timings.groupBy(*keys).pivot("phase").agg(F.sum("value"))


def combined(timings: DataFrame, keys: list[str], last: str = "Overall") -> DataFrame:
    """(keys..., phase, mean, std): means over runs; std: the population deviation, for the last phase alone."""
    return timings.groupBy(*keys, "phase").agg(F.avg("value").alias("mean"), F.when(F.col("phase") == last, F.stddev_pop("value")).alias("std"))


def restricted(rows: DataFrame, limits: dict[str, object]) -> DataFrame:
    """Rows whose string columns match a regular expression and whose others equal a value."""
    kinds = dict(rows.dtypes)
    for name, x in limits.items():
        rows = rows.where(F.col(name).rlike(x) if kinds[name] == "string" else F.col(name) == x)
    return rows


def ordered(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a listed order of one column's values; others come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), column)


def throughput(rows: DataFrame, count: str, phase: str, name: str) -> DataFrame:
    """Adds count per second of a phase in milliseconds."""
    return rows.withColumn(name, F.col(count) / (F.col(phase) / 1000))


def seconds(rows: DataFrame, phase: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.col(phase) / 1000)


