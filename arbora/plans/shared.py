"""Tables in the folder that all machines share: how loops cut their lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where all runs in one process, a folder of this machine is set if none is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="arbora-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/arbora/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later work doesn't depend on executors that made it."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out = out.hint(hint) if (hint := _hint(out, path)) else out
    _STORED.add(out)
    return out


#: Bytes of rows above which a table isn't broadcast. Spark goes by the size of files, of which a byte may be 60 of rows.
LARGE = 32 << 20
#: Files of fewer bytes hold small tables.
TINY = 1 << 16


def _in_memory(rows: int, columns: int) -> int:
    """Bytes that so many rows of so many BIGINTs take once they are broadcast, about."""
    return rows * 8 * (columns + 5)


def unbroadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows at most, kept from being broadcast if they are many. For unions, which take no hints from their parts."""
    return df.hint("merge") if _in_memory(rows, len(df.columns)) > LARGE else df


def _hint(df: DataFrame, path: str) -> str | None:
    """How joins take a table that lies in path: large ones are shuffled, and what the session's limit allows is broadcast, also to large ones."""
    spark = df.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = top.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(top).getLength()
    size = length
    if length > TINY:
        lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
        rows, *values = df.agg(F.count("*"), *[F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in lists]).first()
        size = _in_memory(rows, len(df.columns)) + 32 * sum(values)
    if size > LARGE:
        return "merge"
    limit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower())
    return "broadcast" if limit and size <= int(limit[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[limit[2]] else None


#: Tables that saved() returned, as they are.
_STORED: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def stored(df: DataFrame, columns: Sequence[str], name: str = "t") -> DataFrame:
    """These columns of df, which is written unless it is a saved() or derived() table already."""
    return df.select(*columns) if df in _STORED else saved(df.select(*columns), name)


def derived(df: DataFrame) -> DataFrame:
    """df, a filter or projection of a saved() table, which stored() then takes as it is."""
    _STORED.add(df)
    return df


def forget(*dfs: DataFrame) -> None:
    """Deletes the files behind saved() tables that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/arbora/" in top:
                path = spark._jvm.org.apache.hadoop.fs.Path(top)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
