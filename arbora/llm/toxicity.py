"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its character n-grams (lower-cased; orders `orders`), hashed into `2**bits` buckets. On
labelled rows the log ratio r of smoothed n-gram counts in toxic and other texts is taken, and a logistic regression is
fitted over the features scaled by r. What scores a text is one weight for each bucket.

Defined cases: null, empty and letterless texts have no features and get the score of the intercept; labels that are
null, or whose document is missing, aren't learned from; a document labelled twice takes its largest label; without
labels of both kinds all scores are the smoothed share of toxic labels. Ids may repeat or be null: each row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class ToxicityParams:
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    smoothing: float = 0.5
    #: A log ratio counts from so many times its standard error on.
    min_z: float = 2.5
    l2: float = 0.3
    rounds: int = 100
    #: Bounds of the labelled sample that the fit takes: rows of each label (smallest hashes of the id), characters of a
    #: row, characters in all.
    sample_rows: int = 3000
    sample_row_chars: int = 50_000
    sample_chars: int = 8_000_000
    threshold: float = 0.7
    seed: int = 11


def buckets(text: str, p: ToxicityParams) -> np.ndarray:
    """The buckets of a text's n-grams, one for each place."""
    codes = common.char_codes([" " + " ".join(text.lower().split()) + " "], 0)[0]
    h, out = np.zeros(len(codes), np.uint32), []
    for n in range(1, min(max(p.orders), len(codes)) + 1):  # the hash of n characters from that of n - 1
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193)
        h += codes[n - 1 :]
        if n in p.orders:
            x = (h ^ (h >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * n * 0x9E3779B1) & 0xFFFFFFFF)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x >>= np.uint32(32 - p.bits)
            out.append(x)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        active, z = self.weights != 0, np.full(len(texts), self.intercept)
        for i, t in enumerate(texts):
            h = buckets(t or "", self.params)
            z[i] += self.weights[np.unique(h[active[h]])].sum(dtype=np.float64)  # few buckets have a weight
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled_ids(labels: DataFrame, label: str, rows: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of at most `rows` labelled documents of each label, chosen by the hash of the id."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    return common.hash_sample(own.where("y = 0"), "id", rows, seed).unionByName(common.hash_sample(own.where("y = 1"), "id", rows, seed))


def ratios(sample: DataFrame, p: ToxicityParams) -> pd.DataFrame:
    """(bucket, r): the log-count ratios that exceed their own error. Texts are counted in the tasks; the driver gets no more than these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << p.bits), np.int32)
        for pdf in batches:
            for y, t in zip(pdf["y"], pdf["text"], strict=True):
                seen[y, np.unique(buckets(t, p))] += 1
        held = np.flatnonzero(seen.any(0))
        yield pd.DataFrame({"bucket": held, "n0": seen[0, held], "n1": seen[1, held]})

    counts = common.saved(sample.select("y", "text").mapInPandas(run, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "ngrams")
    total = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")).first()
    s0, s1 = F.col("n0") + p.smoothing, F.col("n1") + p.smoothing
    t0, t1 = ((total[c] or 0) + p.smoothing * (1 << p.bits) for c in ("t0", "t1"))
    own = counts.select("bucket", (F.log(s1 / F.lit(t1)) - F.log(s0 / F.lit(t0))).alias("r"), (1 / s0 + 1 / s1).alias("error"))
    out = own.where(F.col("r") * F.col("r") >= p.min_z**2 * F.col("error")).select("bucket", "r").toPandas().sort_values("bucket")  # 2**bits rows at most
    common.forget(counts)
    return out


def fit(sample: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """sample: a bounded table with columns id, y (0 or 1) and text."""
    shares = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weights, share = np.zeros(1 << p.bits, np.float32), (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    if len(shares) < 2:
        return ToxicityModel(p, weights, float(np.log(share / (1 - share))))
    common.short_batches(sample.sparkSession)
    found = ratios(sample, p)
    bucket, r = found["bucket"].to_numpy(), found["r"].to_numpy()
    held = sample.sparkSession.sparkContext.broadcast(bucket)  # 2**bits at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        for pdf in batches:
            own = [np.flatnonzero(np.isin(known, buckets(t, p))).astype(np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"].astype(str), "y": pdf["y"], "features": own})

    rows = sample.select("id", "y", "text").mapInPandas(run, "id string, y int, features binary").toPandas().sort_values("id")
    y, size = rows["y"].to_numpy().astype(float), len(bucket)
    lens = rows["features"].str.len().to_numpy() // 4
    cols = np.frombuffer(b"".join(rows["features"]), np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    del rows
    w, b = logistic(cols, owner, y, r, size, p)
    weights[bucket] = w
    return ToxicityModel(p, weights, b)


def logistic(cols: np.ndarray, owner: np.ndarray, y: np.ndarray, r: np.ndarray, size: int, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights and intercept over features scaled by r. Row owner[i] has feature cols[i]."""
    # Full-batch Nesterov steps with an adaptive step size; both labels weigh half.
    cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(size), 0.0
    ahead_w, ahead_b, step, last = w, b, 1.0, np.inf
    for k in range(1, p.rounds + 1):
        z = np.bincount(owner, weights=(ahead_w * r)[cols], minlength=len(y)) + ahead_b
        prob = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = float((cost * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + p.l2 * 1e-4 * (ahead_w**2).sum())
        if loss > last:  # overshot: go on from the last good point with a shorter step
            step, last = step / 2, np.inf
            ahead_w, ahead_b = w, b
            continue
        g = cost * (prob - y)
        gw = np.bincount(cols, weights=g[owner], minlength=size) * r + 2 * p.l2 * 1e-4 * ahead_w
        new_w, new_b = ahead_w - step * gw, ahead_b - step * g.sum()
        pace = (k - 1) / (k + 2)
        ahead_w, ahead_b = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b, step, last = new_w, new_b, step * 1.1, loss
    z = np.bincount(owner, weights=(w * r)[cols], minlength=len(y)) + b
    a, c = _platt(z, y)
    return (a * w * r).astype(np.float32), float(a * b + c)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn margins into probabilities at the sample's own label shares."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + c, -50, 50)))
        h = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((q - t) * z).sum(), (q - t).sum()])
        m = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(m, g)
        a, c = a - d[0], c - d[1]
        if abs(d).max() < 1e-8:
            break
    return (a, c) if np.isfinite([a, c]).all() and 0 < a < 1e3 else (1.0, 0.0)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) for each row; other columns of docs aren't read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input

    def make():
        m = held.value
        return lambda texts: [(float(s), int(s >= m.params.threshold)) for s in m.scores(texts)]

    return common.map_texts(docs, make, "score double, predicted int", id_col, text_col)


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    ids = labelled_ids(labels, "toxic", p.sample_rows, p.seed, id_col)
    return fit(common.saved(common.text_sample(docs, ids, p.sample_chars, p.sample_row_chars, p.seed, id_col, text_col), "sample"), p)
