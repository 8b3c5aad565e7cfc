"""Lowest common ancestors for a stream of node pairs: a stateless join of the stream with a static index."""

from __future__ import annotations

from arbora.operators.lca import by_inlabel, index
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def pairs(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The stream (qid, x, y) of a folder of Parquet files, in micro-batches of so many files."""
    return spark.readStream.schema("qid long, x long, y long").option("maxFilesPerTrigger", files).parquet(path)


def answers(queries: DataFrame, tree: DataFrame) -> DataFrame:
    """(qid, x, y, lca) of a streaming (qid, x, y); the index is built once, before the stream starts."""
    nodes, paths = index(tree)
    return by_inlabel(queries, nodes, paths)


def write(queries: DataFrame, tree: DataFrame, path: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Appends the answers to Parquet files, each micro-batch once, also where it goes on from its checkpoint. available:
    ends after what is there now."""
    out = answers(queries, tree).writeStream.format("parquet").outputMode("append")
    out = out.option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available else out).start()


def drain(queries: DataFrame, tree: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All answers so far: those of earlier runs from this checkpoint and of what has come since."""
    write(queries, tree, path, checkpoint, available=True).awaitTermination()
    return queries.sparkSession.read.schema("qid long, x long, y long, lca long").parquet(path)
