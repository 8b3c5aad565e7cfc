"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return a DataFrame.

All but the last return the columns of documents. A document that is several rows is treated alike in all of them.
"""

from __future__ import annotations

from arbora.llm import common, lines, minhash, mixing, suffix, toxicity
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier, fitted on labelled documents, rejects; those with a null id are taken by their text."""
    docs = docs.select(*COLUMNS, common.document_key("doc_id", "text").alias("_document"))
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = toxicity.score(docs, model, "_document").where("predicted = 1").select("_document").distinct()
    return docs.join(rejected, "_document", "left_anti").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; documents that were nothing else go."""
    kept = lines.deduplicated(docs.select(COLUMNS)).where("n_dropped = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.deduplicated(docs.select(COLUMNS)).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more is benchmark text."""
    return suffix.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes: (doc_id, source, size, source_size, target, taken)."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]

#: SQL can't express the fitted classifier and the random flight.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
