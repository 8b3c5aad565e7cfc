"""Shared pieces: Python over texts, sieves, folds and samples, vectorised tokenising and hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from arbora.plans.shared import forget, saved, shared_dir  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows in an Arrow batch sent to Python: whole texts travel, so batches stay short.
BATCH_ROWS = 512
#: Bytes or characters that one numpy step works on; longer documents make a step of their own.
STEP = 1 << 20


def document_key(id_col: str, text_col: str) -> Column:
    """Names a row's document; rows with a null id are taken by their text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.coalesce(F.col(text_col), F.lit("")))))


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], ddl: str, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., columns of ddl) for each row. make() is called once in a task and gives a function from the
    values of text_col in a batch (nulls are None) to one tuple for each. Ids and kept columns stay in Arrow, so null
    and large ones come back as they were."""
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    added = StructType.fromDDL(ddl)
    kinds, names = [to_arrow_type(f.dataType) for f in added], ["id", *keep, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in batches:
            rows = rows_of(batch.column(len(keep) + 1).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    schema = StructType([*own.schema.fields[: len(keep) + 1], *added.fields])
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# --- sieves ----------------------------------------------------------------------------------

#: Bits of a sieve: it is broadcast as at most 2**SIEVE_BITS / 64 rows of two longs.
SIEVE_BITS = 24


def sieved(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a 64-bit hash) may be among keys: none that is gets lost, and few others stay while keys are
    much fewer than the sieve's bits. It spares the shuffle of rows that a following join drops."""
    return _held(rows, _sieve(keys, key), key, "inner").where(f"getbit(_bits, {_bit(key)}) = 1").drop("_word", "_bits")


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what sieved gives, all other rows): a left join with keys needs to shuffle the first part alone. The key isn't null."""
    sieve = saved(_sieve(keys, key), "sieve")
    rest = _held(rows, sieve, key, "left").where(f"coalesce(getbit(_bits, {_bit(key)}), 0) = 0")
    return tuple(part.drop("_word", "_bits") for part in (_held(rows, sieve, key, "inner").where(f"getbit(_bits, {_bit(key)}) = 1"), rest))


def _word(key: str) -> str:
    return f"shiftrightunsigned({key}, {64 - SIEVE_BITS + 6})"


def _bit(key: str) -> str:
    return f"cast(shiftrightunsigned({key}, {64 - SIEVE_BITS}) & 63 as int)"


def _sieve(keys: DataFrame, key: str) -> DataFrame:
    return keys.groupBy(F.expr(_word(key)).alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, {_bit(key)}))").alias("_bits"))


def _held(rows: DataFrame, sieve: DataFrame, key: str, how: str) -> DataFrame:
    return rows.join(F.broadcast(sieve), F.expr(_word(key)) == F.col("_word"), how)  # at most 2**SIEVE_BITS / 64 rows


# --- folds -----------------------------------------------------------------------------------


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo folds; null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, out: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def hash_sample(df: DataFrame, by: str, limit: int, seed: int) -> DataFrame:
    """At most limit rows, those with the smallest hash of a column: the same rows in each run."""
    return df.orderBy(F.xxhash64(F.col(by).cast("string"), F.lit(seed)), F.col(by)).limit(limit)


def text_sample(docs: DataFrame, ids: DataFrame, chars: int, row_chars: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text) of the documents of ids (id, y; a bounded sample with distinct ids): one text of each id, of at most
    row_chars characters, in the order of hashed ids as far as all have at most chars characters. It is cut before
    anything goes to the driver."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= row_chars)
    held = saved(texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "sample")
    order = Window.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each sampled id
    fits = held.select("id", F.sum(F.length("text")).over(order).alias("n")).where(F.col("n") <= chars).select("id")
    return held.join(F.broadcast(fits), "id").repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "id")  # few rows, much work


# --- numpy text work -------------------------------------------------------------------------

_U = np.uint64
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP + 64), base, _U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words whose output bits depend on all input bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[starts[i]:ends[i]], all from one running sum."""
    n = len(codes)
    total = np.zeros(n + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * _power(_Q, n)[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * _power(_QINV, n + 1)[starts] + (ends - starts).astype(_U))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _table(word: str) -> np.ndarray:
    out = np.ones(256, bool)
    if word == "space":  # [^\x20\x09-\x0D]+
        out[[0x20, *range(0x09, 0x0E)]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
        out[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
    return out


WORD_TABLES = {"space": _table("space"), "alnum": _table("alnum")}


def steps(texts, size: int = STEP):
    """Consecutive slices (first, last) of texts that hold about size characters each."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[str], word: str) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z lower-cased, in order. Null is empty."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    out: list[np.ndarray] = []
    for a, b in steps(raw):
        codes = np.frombuffer(b" ".join(raw[a:b]) + b" ", np.uint8)
        starts, ends = runs(WORD_TABLES[word][codes])
        hashes = run_hashes(codes, starts, ends)
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw[a:b]]))
        first = 0
        for cut in cuts:
            out.append(hashes[first:cut])
            first = cut
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; with fewer words the whole sequence is the one shingle."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    total = np.zeros(n - k + 1, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * _U(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
        return np.unique(mix64(total + _U(k)))


def char_codes(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by gap zeros, and the texts' first positions with the end."""
    pad = "\0" * gap
    codes = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "replace"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(t) + gap for t in texts])))
