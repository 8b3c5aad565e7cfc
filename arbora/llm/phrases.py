"""Phrases of words that occur together more often than apart, by level-wise passes.

A-Z are lower-cased, texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. Everything
is counted by language (null: `und`).

* Level 1 counts all words; level k reads the texts again and emits a k-gram only where both (k-1)-grams in it are
  frequent: f >= `least`. What tasks know of the level before is a bit table of 2**SIEVE_BITS bits, broadcast, whatever
  the number of frequent phrases: it never loses one, and what it lets through in error is counted and dropped.
  Tasks count by exact phrases within steps of `STEP` bytes, cut between pieces, before anything is shuffled.
* A candidate (2 to `longest` words) has a score for each cut, floor(2000000 a / (l + r)), from the level tables: its
  parts are as frequent as it is at least, so they are in them. The lowest-scoring cut counts, then the shortest first part.
* A candidate inside another that has 80 % of its occurrences is dropped. Those with one more word suffice: what a
  longer one covers, the one between covers too.

Defined cases: null and empty texts and texts without words add nothing; repeated rows count each; a piece of any length
is one piece; a language without frequent phrases has no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of the table of frequent phrases that a task holds: 16 MB.
SIEVE_BITS = 27
#: Bytes that a task counts at once.
STEP = 1 << 22

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_U = np.uint64


@dataclass(frozen=True)
class PhraseParams:
    least: int = 30
    longest: int = 4
    inside: int = 80
    top: int = 2000


# --- counting in a task ----------------------------------------------------------------------


def _hashes(words: np.ndarray, k: int, lang: str) -> np.ndarray:
    """Hashes of the k-grams from each place on, from those of their words."""
    total = np.full(max(0, len(words) - k + 1), _U(len(lang.encode())) + _U(0x9E3779B97F4A7C15), _U)
    total += common.run_hashes(np.frombuffer(lang.encode() + b"\n", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))[0]
    for j in range(k):
        total = common.mix64(total * _U(0xD6E8FEB86659FD93) + words[j : len(total) + j])
    return total


def _word_hashes(names: pa.StringArray) -> np.ndarray:
    """Hashes of a dictionary's words: those of its texts have them too, and it is much shorter."""
    _, at, text = names.buffers()
    at = np.frombuffer(at, np.int32, len(names) + 1, 4 * names.offset)
    return common.run_hashes(np.frombuffer(text, np.uint8) if text else np.empty(0, np.uint8), at[:-1], at[1:])


def _bit(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> _U(64 - SIEVE_BITS)
    return (sieve[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both are (each below 2**31)."""
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]


def counted(lang: str, raw: bytes, k: int, sieve: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """(phrases, counts) of the k-grams of a lower-cased text whose (k-1)-grams are in the sieve; level 1 also has the number of all words, as phrase ''."""
    codes = np.frombuffer(raw + b" ", np.uint8)
    inside = _WORD[codes]
    starts, ends = common.runs(inside)
    n = len(starts)
    if n < k:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(codes[inside])).dictionary_encode()
    names, word = words.dictionary, words.indices.to_numpy()
    if k == 1:
        return pa.concat_arrays([names, pa.array([""])]), np.append(np.bincount(word), n)
    piece = np.cumsum(_BREAK[codes], dtype=np.int32)[starts]
    known = _bit(sieve, _hashes(_word_hashes(names)[word], k - 1, lang))
    first = np.flatnonzero((piece[: n - k + 1] == piece[k - 1 :]) & known[:-1] & known[1:])
    spots = [word[first + j] for j in range(k)]
    while len(spots) > 1:
        spots = [*(_pairs(a, b) for a, b in zip(spots[::2], spots[1::2])), *spots[len(spots) // 2 * 2 :]]
    _, where, counts = np.unique(spots[0], return_index=True, return_counts=True)
    parts = [names.take(pa.array(word[first[where] + j])) for j in range(k)]
    return pc.binary_join_element_wise(*parts, " "), counts


def steps(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, one in a line, in steps of about STEP bytes that end between pieces."""
    held, size = [], 0
    for text in texts:
        while len(text) > STEP:
            cuts = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8)])
            at = cuts[max(0, np.searchsorted(cuts, STEP) - 1)] if len(cuts) else len(text)
            yield text[:at]
            text = text[at + 1 :]
        held.append(text)
        size += len(text)
        if size > STEP:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def _level(docs: DataFrame, k: int, sieve: np.ndarray | None) -> DataFrame:
    """(lang, phrase, n) of k-grams as tasks count them. docs: (lang, text)."""
    table = docs.sparkSession.sparkContext.broadcast(sieve)  # 2**SIEVE_BITS bits

    def rows(lang: str, raw: bytes) -> pa.RecordBatch:
        phrases, n = counted(lang, raw, k, table.value)
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), phrases, pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text.lower())
                size += len(text) + 64
            if size > 2 * STEP:
                for lang, texts in held.items():
                    for raw in steps(texts):
                        yield rows(lang, raw)
                held, size = {}, 0
        for lang, texts in held.items():
            for raw in steps(texts):
                yield rows(lang, raw)

    common.short_batches(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _sieve(frequent: DataFrame, k: int) -> np.ndarray:
    """The bit table of the phrases of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bits = [], []
            for lang, phrases in batch.to_pandas().groupby("lang")["phrase"]:
                codes = np.frombuffer("\n".join(phrases).encode() + b" ", np.uint8)
                hashes = _hashes(common.run_hashes(codes, *common.runs(_WORD[codes])), k, lang)[::k]  # each phrase has k words
                at = hashes >> _U(64 - SIEVE_BITS)
                words.append((at >> _U(6)).astype(np.int64))
                bits.append((_U(1) << (at & _U(63))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words or [np.empty(0, np.int64)])), pa.array(np.concatenate(bits or [np.empty(0, np.int64)]))], ["word", "bits"])

    got = frequent.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**SIEVE_BITS / 64 rows
    out = np.zeros(1 << (SIEVE_BITS - 6), _U)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(_U)
    return out


# --- level tables and scores -----------------------------------------------------------------


def levels(docs: DataFrame, p: PhraseParams = PhraseParams(), lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, n): all words; (lang, phrase, k, f): the frequent phrases of up to `longest` words)."""
    own = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    first = common.saved(_level(own, 1, None).where((F.col("n") >= p.least) | (F.col("phrase") == "")), "words")
    words = first.where("phrase = ''").select("lang", "n")
    found = [first.where((F.col("phrase") != "") & (F.col("n") >= p.least)).select("lang", "phrase", F.col("n").alias("f"))]
    for k in range(2, p.longest + 1):
        level = _level(own, k, _sieve(found[-1], k - 1)).where(F.col("n") >= p.least)
        found.append(common.saved(level.select("lang", "phrase", F.col("n").alias("f")), "phrases"))
    out = None
    for k, x in enumerate(found, 1):
        x = x.withColumn("k", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return words, out


def scored(table: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of candidates that no longer one covers."""
    words = F.split("phrase", " ")

    def part(first, n):
        return F.array_join(F.slice(words, first, n), " ")

    cand = table.where("k > 1").withColumnRenamed("f", "a")
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left, right = (table.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # floor(2000000 a / s) in two digits of base 1000 and 2000, so that no product passes 64 bits below 4 * 10**15 occurrences.
    score = F.expr("2000 * (1000 * a div (l + r)) + 2000 * (1000 * a % (l + r)) div (l + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    inner = cand.where("k > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < p.inside * F.col("a")))
    return kept.select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def top_phrases(docs: DataFrame, p: PhraseParams = PhraseParams(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` by score, then a, then phrase."""
    words, table = levels(docs, p, lang_col, text_col)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # limited before the shuffle
    first = scored(table, p).withColumn("rank", rank).where(F.col("rank") <= p.top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    """DuckDB SQL of top_phrases on `documents` with the usual parameters."""
    return r"""
WITH w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(k) WHERE len(w) >= k)) GROUP BY lang, k, p),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
t AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
c AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM t WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.p, c.a, x.f AS l, y.f AS r, c.cut, CAST(floor(2000000 * c.a::HUGEINT // (x.f + y.f)) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN t x ON x.lang = c.lang AND x.p = array_to_string(c.w[1:c.cut], ' ') JOIN t y ON y.lang = c.lang AND y.p = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
sub AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(a) AS longer FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) x(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN sub s ON s.lang = b.lang AND s.p = b.p WHERE s.longer IS NULL OR 100 * s.longer < 80 * b.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS BIGINT) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) <= 2000"""
