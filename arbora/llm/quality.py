"""Quality: positive-unlabelled learning with the non-negative risk.

Trusted positives are documents labelled as good; the unlabelled set is plain documents, good and bad mixed, whose
labels (if any) aren't looked at. The share of good texts in the unlabelled set (the class prior) is estimated from
the two sets alone: over score thresholds, the smallest upper bound of the ratio of the unlabelled set's upper tail to
the positives' upper tail, over all documents that the scorer wasn't fitted on. A logistic model over surface features then
minimises the unbiased risk  prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).

Features of a text, all from its characters: shares of character shapes and of their pairs and triples (letters lose
their identity, punctuation keeps it), and repetition and length figures. So they carry over between languages.

Defined cases: null and empty texts have the feature vector of an empty text; without positives or unlabelled rows each
score is the prior (0.5 without any). Ids may repeat or be null: each row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class QualityParams:
    bits: int = 9
    l2: float = 1e-4
    epochs: int = 60
    batch: int = 512
    rate: float = 0.02
    #: Bounds of the samples that the fit takes: rows of each set (smallest hashes of the id), characters of a row, of both sets.
    sample_rows: int = 4000
    sample_row_chars: int = 50_000
    sample_chars: int = 14_000_000
    #: Confidence of the prior's bound.
    delta: float = 0.1
    threshold: float = 0.5
    seed: int = 23


def _shapes() -> np.ndarray:
    """Shape of each code point below 256: letters by case, digits, white space, punctuation as itself."""
    out = np.zeros(256, np.uint32)
    for c in range(256):
        ch = chr(c)
        out[c] = 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch == "\n" else 5 if ch.isspace() else 6 + c
    out[0] = 0
    return out


_SHAPES = _shapes()


def features(texts: list[str | None], bits: int) -> np.ndarray:
    """One row for each text: square roots of shape n-gram shares (hashed), then repetition and length figures."""
    size, out = 1 << bits, []
    texts = [t or "" for t in texts]
    for a, b in common.steps(texts):
        part = texts[a:b]
        codes, first = common.char_codes(part, 3)
        shape = np.where(codes < 256, _SHAPES[np.minimum(codes, 255)], 1).astype(np.uint32)
        n = len(part)
        owner = np.repeat(np.arange(n), np.diff(first))
        counts = np.zeros((n, size), np.float32)
        h = np.zeros(len(shape), np.uint32)
        for k in (1, 2, 3):
            h = h[: len(shape) - k + 1] * np.uint32(0x01000193) + shape[k - 1 :] + np.uint32(1)
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            at = owner[: len(x)] * size + (x >> np.uint32(32 - bits))
            counts += np.bincount(at[shape[: len(x)] != 0], minlength=n * size).reshape(n, size)
        rows = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        starts, ends = common.runs((shape != 0) & (shape != 4) & (shape != 5))
        words, cuts = common.run_hashes(codes, starts, ends), np.searchsorted(starts, first)
        extra = np.zeros((n, 6), np.float32)
        for i in range(n):
            w, length = words[cuts[i] : cuts[i + 1]], len(part[i])
            if len(w):
                kinds = len(np.unique(w))
                extra[i] = (kinds / len(w), (w[1:] == w[:-1]).mean() if len(w) > 1 else 0, np.log1p(len(w)) / 8, np.log1p(length / len(w)) / 3, part[i].count("\n") / len(w), 1)
        out.append(np.hstack([rows, extra]))
    return np.vstack(out) if out else np.zeros((0, size + 6), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    prior: float
    weights: np.ndarray
    intercept: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        return ((features(texts, self.params.bits) - self.mean) * self.scale) @ self.weights + self.intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        return _sigmoid(self.margins(texts)).astype(float)


def risk_minimiser(pos: np.ndarray, unl: np.ndarray, prior: float, p: QualityParams) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk under logistic loss, by Adam over mini-batches."""
    rng = np.random.default_rng(p.seed)
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v, k, total, kept = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0, np.zeros(len(w) + 1), 0
    for epoch in range(p.epochs):
        order = rng.permutation(len(unl))
        for at in range(0, len(unl), p.batch):
            xu = unl[order[at : at + p.batch]]
            xp = pos[rng.integers(0, len(pos), min(p.batch, len(pos)))]
            sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
            negative = -np.log(np.maximum(1 - su, 1e-12)).mean() - prior * -np.log(np.maximum(1 - sp, 1e-12)).mean()
            to_p, to_u = prior * (sp - 1) / len(xp), su / len(xu)
            if negative >= 0:
                gp, gu = to_p - prior * sp / len(xp), to_u
            else:  # the negative part has gone below zero: undo the overfit
                gp, gu = prior * sp / len(xp), -to_u
            g = np.append(xp.T @ gp + xu.T @ gu + p.l2 * w, gp.sum() + gu.sum())
            k += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = p.rate * (1 - epoch / p.epochs) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
        if epoch >= p.epochs * 2 // 3:  # the mean of the last third of the epochs
            total, kept = total + np.append(w, b), kept + 1
    return total[:-1] / kept, float(total[-1] / kept)


def class_prior(pos: np.ndarray, above: np.ndarray, total: int, delta: float) -> float:
    """The positives' share of the unlabelled scores: smallest upper bound of tail ratios. pos: sorted scores of
    positives; above[i]: how many of the total unlabelled scores are at least pos[i] (no other cut can do better)."""
    tail_p = 1 - np.searchsorted(pos, pos) / len(pos)
    tail_u = above / max(total, 1)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(max(total, 1)))
    ok = tail_p > max(0.1, 2 * slack)
    at = np.argmin(np.where(ok, (tail_u + slack) / np.maximum(tail_p, 1e-9), np.inf))
    return float(np.clip(tail_u[at] / tail_p[at], 0.02, 0.98)) if ok.any() else 0.5


def _scaled(xp: np.ndarray, xu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    both = np.vstack([xp, xu])
    mean, scale = both.mean(0), 1 / np.maximum(both.std(0), 0.02)
    return (xp - mean) * scale, (xu - mean) * scale, mean, scale


def fit(positive: list[str | None], unlabelled: list[str | None], prior: float, p: QualityParams = QualityParams()) -> QualityModel:
    if not positive or not unlabelled:
        return QualityModel(p, prior, np.zeros(0), 0.0)
    xp, xu, mean, scale = _scaled(features(positive, p.bits), features(unlabelled, p.bits))
    return QualityModel(p, prior, *risk_minimiser(xp, xu, prior, p), mean, scale)


def estimated_prior(texts: DataFrame, positive: list[str], unlabelled: pd.DataFrame, p: QualityParams) -> float:
    """The class prior over all of texts (id, text): a scorer fitted on halves of the samples scores every other row."""
    first = unlabelled.iloc[::2]
    halves = fit(positive[::2], first["text"].tolist(), 0.5, p)
    cuts = np.sort(halves.margins(positive[1::2]))
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((halves, cuts, set(first["id"].astype(str))))  # at most sample_rows ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, at, fitted = held.value
        counts = np.zeros(len(at) + 1, np.int64)
        for pdf in batches:
            rest = [t for i, t in zip(pdf["id"], pdf["text"], strict=True) if i not in fitted]
            counts += np.bincount(np.searchsorted(at, model.margins(rest), side="right"), minlength=len(at) + 1)
        yield pd.DataFrame({"cut": np.arange(len(counts)), "n": counts})

    own = texts.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "cut int, n long")
    n = np.zeros(len(cuts) + 1, np.int64)
    for r in own.groupBy("cut").agg(F.sum("n").alias("n")).collect():  # a row for each positive of the sample
        n[r["cut"]] = r["n"]
    return class_prior(cuts, np.cumsum(n[::-1])[::-1][1:], int(n.sum()), p.delta)


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """docs: the rows that may be learned from. Positives are those with label quality = 1; the unlabelled set is all of docs, of which a sample fits the weights and every row counts for the class prior."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    common.short_batches(docs.sparkSession)
    good = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("y")).where("id is not null").groupBy("id").agg(F.min("y").alias("y")).where("y = 1")

    def taken(ids: DataFrame, seed: int) -> pd.DataFrame:
        pdf = common.text_sample(texts, ids, p.sample_chars // 2, p.sample_row_chars, seed, "id", "text").select("id", "text", F.xxhash64(F.col("id").cast("string"), F.lit(seed)).alias("h")).toPandas()
        return pdf.sort_values("h", kind="stable")

    positive = taken(common.hash_sample(good, "id", p.sample_rows, p.seed), p.seed)["text"].tolist()
    unlabelled = taken(common.hash_sample(texts.select("id").distinct(), "id", p.sample_rows, p.seed + 1).withColumn("y", F.lit(0)), p.seed + 1)
    prior = 0.5 if min(len(positive), len(unlabelled)) < 20 else estimated_prior(texts, positive, unlabelled, p)
    return fit(positive, unlabelled["text"].tolist(), prior, p)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) for each row; other columns of docs aren't read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input

    def make():
        m = held.value
        return lambda texts: [(float(s), int(s >= m.params.threshold)) for s in m.scores(texts)]

    return common.map_texts(docs, make, "score double, predicted int", id_col, text_col)
