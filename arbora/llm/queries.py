"""The queries opN_<name>: each applies its operator to its whole table and gives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, common, isomedia, langid, lines, minhash, mixing, phrases, pii, postings, quality, suffix, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~common.held_out(F.col("doc_id"), 4, 2)))
    return langid.predict(docs, model).withColumn("held_out", common.held_out(F.col("doc_id"), 4, 2)).select("doc_id", "held_out", "lang_pred", "score", "n_letter_words", "n_switches")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = common.held_out(F.col("doc_id"), 3, 1)
    model = quality.train(docs.where(~out), labels.where(~out))
    return quality.score(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "score", "predicted")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = common.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs.where(~out), labels.where(~out))
    return toxicity.score(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), minhash.MinHashParams(shingle=2))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))

    def text(x):
        return F.concat_ws(":", x["kind"], x["first"].cast("string"), x["end"].cast("string"))

    kinds = F.array(*[F.lit(k) for k in (*pii.KINDS, pii.SECRET)])
    every = F.concat(*[F.transform(c, lambda x: F.struct(F.array_position(kinds, x["kind"]).alias("o"), x["first"].alias("first"), x["end"].alias("end"), x["kind"].alias("kind"))) for c in ("base", "found")])

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = found.withColumn("every", F.sort_array(every))
    digest = F.sha2(F.array_join(F.transform("base", text), ","), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, pii.KINDS), digest, F.array_join(F.transform("every", text), ",").alias("spans"), F.size("found").cast("long").alias("n_found"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.digests(isomedia.to_media(table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii": op8_pii,
    "op9_media": op9_media,
    "op10_decontaminate": op10_decontaminate,
    "op11_neighbours": op11_neighbours,
    "op12_phrases": op12_phrases,
    "op13_audit": op13_audit,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_url_filter": urls.sql(),
    "op12_phrases": phrases.sql(),
    "op13_audit": audit.sql(),
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, s, occ.k AS k, item_id FROM occ JOIN win ON occ.g = win.g AND occ.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
