"""Language ID: a linear-chain conditional random field that labels the words of code-switched text.

A word is a run of letters. Its features are hashed character n-grams with the word's borders as characters (those that
touch a border are its affixes) and its place in a lexicon of words that many training documents share. Label weights
and label-to-label transitions are learned together by maximising the conditional likelihood of chains, which are put
together from runs of words of documents with different known languages. Words get posterior label shares by
forward-backward; a document's language is the one with the largest sum of shares. A text is one chain, however long:
numpy works on spans of `span` words, and what a span passes to its neighbours goes through the spans' transfer matrices.

Defined cases: null texts and texts without letters are `und` with score 0; without any labelled document every text
with letters is `und` too. Ties go to the smaller label. Ids may repeat or be null: each row is labelled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangParams:
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 15
    span: int = 64
    #: Words join the lexicon from so many training documents on.
    lexicon_docs: int = 5
    lexicon_size: int = 4096
    #: Bounds of the labelled sample: documents of each language, characters of a document.
    sample_rows: int = 300
    sample_row_chars: int = 20_000
    #: Training chains, the mean run of words before a switch of language, words of a chain.
    chains: int = 3000
    run: int = 20
    chain_words: int = 40
    rounds: int = 40
    rate: float = 0.15
    l2: float = 1e-6
    seed: int = 5


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass(frozen=True)
class Words:
    """The words of some texts and their features. Feature k of words is gram[k] with the word place owner[k]; -1 in lexicon: none."""

    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    hashes: np.ndarray
    grams: list[np.ndarray]


def words_of(texts: list[str], p: LangParams) -> Words:
    """cuts: for each text its first word, then the number of words. grams: for each order the bucket of the n-gram at each place, 2**bits where it's none."""
    codes, first = common.char_codes(["\0" + t.lower() for t in texts], 4)
    inside = _letters()[np.minimum(codes, 0x10FFFF)]
    codes = np.where(inside, codes, 0).astype(np.uint32)
    starts, ends = common.runs(inside)
    grams, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(p.orders) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193)
        h += codes[n - 1 :]
        if n not in p.orders:
            continue
        m = len(codes) - n + 1
        ok = inside[:m] | inside[1 : m + 1] if n == 2 else np.logical_and.reduce([inside[j : m + j] for j in range(1, n - 1)])
        x = (h ^ (h >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * n * 0x9E3779B1) & 0xFFFFFFFF)
        x ^= x >> np.uint32(13)
        x = (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - p.bits)
        grams.append(np.where(ok, x, np.uint32(1 << p.bits)))
    return Words(starts, ends, np.searchsorted(starts, first), common.run_hashes(codes, starts, ends), grams)


@dataclass(frozen=True)
class LangModel:
    params: LangParams
    labels: list[str]
    #: 2**bits rows, then a row of zeros for places without an n-gram; a column for each label.
    weights: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """A row for each word: the summed weights of its features."""
        if not len(w.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        at = np.take(self.weights, w.grams[0], axis=0)
        for g in w.grams[1:]:
            at[: len(g)] += np.take(self.weights, g, axis=0)
        out = np.add.reduceat(at, w.starts - 1, axis=0)  # a word's n-grams start at the border before it and at its letters
        place = lexicon_places(self.lexicon, w.hashes)
        return out + np.where((place >= 0)[:, None], self.lexicon_weights[place], 0)

    def posteriors(self, w: Words) -> np.ndarray:
        """Label shares of each word."""
        e = self.emissions(w)
        grid, used = chain_grid(w.cuts, self.params.span)
        return forward_backward(e, grid, used, self.transitions, chain=np.searchsorted(w.cuts, grid[:, 0], side="right") - 1 if len(grid) else None)[0]


def lexicon_places(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[place] == hashes, place, -1)


def chain_grid(cuts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each span of a chain, a span in a row and those of a chain in order; used: where there is a word."""
    sizes = np.diff(cuts)
    chains = -(-sizes // span)
    owner = np.repeat(np.arange(len(sizes)), chains)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
    first = cuts[owner] + step * span
    width = min(span, int(sizes.max(initial=0)))
    grid = first[:, None] + np.arange(width)
    return grid, grid < cuts[owner + 1][:, None]


def _passed(x: np.ndarray, on: np.ndarray, t: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each span gets from the spans before it (label shares of the word before; zeros at a chain's start) and from
    those after it (backward messages at its last word; ones at a chain's end)."""
    width, k, n = x.shape
    before, after = np.zeros((n, k)), np.ones((n, k))
    at = np.arange(n) - np.searchsorted(chain, chain)
    size = np.bincount(chain, minlength=chain.max(initial=-1) + 1)[chain]
    long = np.flatnonzero(size > 1)
    if not len(long):
        return before, after
    m = np.broadcast_to(np.eye(k), (len(long), k, k)).copy()  # from the label before a span to that of its last word
    for i in range(width):
        step = (m @ t if i else np.where((at[long] > 0)[:, None, None], t, np.eye(k))) * x[i, :, long][:, None, :]
        step /= step.max((1, 2), keepdims=True)
        m = np.where(on[i, long][:, None, None], step, m)
    whole = np.zeros((n, k, k))
    whole[long] = m
    for d in range(1, int(size.max())):
        own = np.flatnonzero((at == d) & (size > d))
        got = np.einsum("nk,nkl->nl", before[own - 1] if d > 1 else np.ones((len(own), k)), whole[own - 1])
        before[own] = got / got.sum(1, keepdims=True)
    for d in range(1, int(size.max())):
        own = np.flatnonzero(size - 1 - at == d)
        got = np.einsum("nkl,nl->nk", whole[own + 1], after[own + 1])
        after[own] = got / got.max(1, keepdims=True)
    return before, after


def forward_backward(e: np.ndarray, grid: np.ndarray, used: np.ndarray, transitions: np.ndarray, counts: bool = False, chain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label shares of words; with counts also the expected transition counts within spans. chain: the chain of
    each span, ascending; without it each span is a chain. Arrays are (place, label, span)."""
    n, width, k = *grid.shape, e.shape[1]
    post, expected = np.zeros(e.shape), np.zeros((k, k))
    if not n or not width:
        return post, expected
    t = np.exp(transitions - transitions.max())
    lone = np.exp(e - e.max(1, keepdims=True))
    x = np.ascontiguousarray(lone[np.where(used, grid, 0).T].transpose(0, 2, 1))
    on = used.T
    before, after = _passed(x, on, t, np.arange(n) if chain is None else chain)
    before, after = before.T, after.T
    alpha, beta, scale = np.empty_like(x), np.empty_like(x), np.empty((width, 1, n), x.dtype)
    for i in range(width):
        alpha[i] = (t.T @ alpha[i - 1]) * x[i] if i else x[0] * np.where(before.any(0), t.T @ before, 1)
        scale[i] = alpha[i].sum(0)
        alpha[i] /= scale[i]
    beta[-1] = after
    for i in range(width - 2, -1, -1):
        pull = x[i + 1] * beta[i + 1] / scale[i + 1]
        if counts:
            expected += (alpha[i] * on[i + 1]) @ pull.T * t
        beta[i] = np.where(on[i + 1], t @ pull, after)
    alpha *= beta
    alpha /= alpha.sum(1, keepdims=True)
    post[grid.T[on]] = alpha.transpose(0, 2, 1)[on]
    return post, expected


def training_chains(texts: list[str], langs: list[str], p: LangParams) -> tuple[list[str], list[list[tuple[int, int]]], list[str]]:
    """Chains of words; for each the (label, number of words) of its runs; the labels."""
    rng = np.random.default_rng(p.seed)
    labels = sorted(set(langs))
    split = ["".join(c if c.isalpha() else " " for c in t).split() for t in texts]
    by = [[s for s, x in zip(split, langs, strict=True) if x == y and s] for y in labels]
    have = [i for i, rows in enumerate(by) if rows]
    chains, runs = [], []
    for _ in range(p.chains if have else 0):
        words, own, lang = [], [], have[rng.integers(len(have))]
        while len(words) < p.chain_words:
            source = by[lang][rng.integers(len(by[lang]))]
            take = min(1 + int(rng.exponential(p.run)), p.chain_words - len(words))
            first = int(rng.integers(max(1, len(source) - take + 1)))
            part = source[first : first + take]
            words += part
            own.append((lang, len(part)))
            lang = have[rng.integers(len(have))]
        chains.append(" ".join(words))
        runs.append(own)
    return chains, runs, labels


def fit(texts: list[str], langs: list[str], p: LangParams = LangParams()) -> LangModel:
    chains, runs, labels = training_chains(texts, langs, p)
    k, size = len(labels), 1 << p.bits
    seen: dict[int, int] = {}
    for t in texts:
        w = words_of([t], p)
        for h in np.unique(w.hashes).tolist():
            seen[h] = seen.get(h, 0) + 1
    often = sorted((-n, h) for h, n in seen.items() if n >= p.lexicon_docs)[: p.lexicon_size]
    lexicon = np.array(sorted(h for _, h in often), np.uint64)
    theta = [np.zeros((size + 1, k)), np.zeros((len(lexicon), k)), np.zeros((k, k))]
    if not chains:
        return LangModel(p, labels, theta[0].astype(np.float32), lexicon, theta[1].astype(np.float32), theta[2])
    w = words_of(chains, p)
    gold = np.concatenate([np.repeat([a for a, _ in own], [n for _, n in own]) for own in runs])
    if len(gold) != len(w.starts):
        raise ValueError("the words of the training chains don't match their labels")
    grid, used = chain_grid(w.cuts, p.chain_words)
    owner = np.searchsorted(w.starts, np.arange(len(w.grams[0]) if w.grams else 0) + 1, side="right") - 1
    places = [(g[ok], np.maximum(owner[: len(g)][ok], 0)) for g in w.grams for ok in [g < size]]
    lex = lexicon_places(lexicon, w.hashes)
    known = np.flatnonzero(lex >= 0)
    gold_t = np.zeros((k, k))
    pair = used[:, 1:]
    np.add.at(gold_t, (gold[grid[:, :-1][pair]], gold[grid[:, 1:][pair]]), 1)
    one = np.eye(k)[gold]
    total = len(gold)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in theta]
    for i in range(1, p.rounds + 1):  # full-batch Adam on the mean log-likelihood of a word
        model = LangModel(p, labels, theta[0].astype(np.float32), lexicon, theta[1].astype(np.float32), theta[2])
        post, expected = forward_backward(model.emissions(w).astype(float), grid, used, theta[2], counts=True)
        d = one - post
        grad = [np.zeros_like(x) for x in theta]
        for g, own in places:
            for c in range(k):
                grad[0][:size, c] += np.bincount(g, weights=d[own, c], minlength=size)
        for c in range(k):
            grad[1][:, c] = np.bincount(lex[known], weights=d[known, c], minlength=len(lexicon))
        grad[2] = gold_t - expected
        for j, x in enumerate(theta):
            g = grad[j] / total - p.l2 * x
            m, v = moments[j]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += p.rate * (1 - (i - 1) / p.rounds) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-7)
        theta[0][size] = 0
    return LangModel(p, labels, theta[0].astype(np.float32), lexicon, theta[1].astype(np.float32), theta[2])


def train(docs: DataFrame, p: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """docs: the rows that may be learned from; those with a null language or id aren't."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(f"lang is not null and id is not null and length(text) between 1 and {p.sample_row_chars}")
    order = F.xxhash64(F.col("id").cast("string"), F.lit(p.seed))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))  # Spark keeps sample_rows rows of a language in each task
    ids = common.saved(own.select("id", "lang", order.alias("h")).withColumn("rank", rank).where(F.col("rank") <= p.sample_rows).select("id", "lang", "h").distinct(), "sample")
    texts = common.sieved(own.withColumn("h", order), ids, "h").join(ids, ["id", "lang", "h"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    pdf = texts.select("lang", F.col("id").cast("string").alias("id"), "text").toPandas().sort_values(["lang", "id"], kind="stable")
    return fit(pdf["text"].tolist(), pdf["lang"].tolist(), p)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, n_letter_words, n_switches) for each row; other columns of docs aren't read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits + lexicon_size weights for each language

    def make():
        m = held.value
        return lambda texts: [r for part in _parts(texts) for r in verdicts(m, part)]

    return common.map_texts(docs, make, "lang_pred string, score double, n_letter_words long, n_switches long", id_col, text_col)


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    texts = [t or "" for t in texts]
    for a, b in common.steps(texts, 1 << 18):
        yield texts[a:b]


def verdicts(m: LangModel, texts: list[str]) -> list[tuple[str, float, int, int]]:
    w = words_of(texts, m.params)
    out, post = [], m.posteriors(w) if m.labels else None
    best = post.argmax(1) if post is not None and len(post) else np.zeros(0, int)
    for a, b in zip(w.cuts[:-1], w.cuts[1:], strict=True):
        if a == b or post is None:
            out.append((UNDETERMINED, 0.0, int(b - a), 0))
            continue
        share = post[a:b].mean(0)
        top = int(share.argmax())
        out.append((m.labels[top], float(min(1.0, share[top])), int(b - a), int((best[a + 1 : b] != best[a : b - 1]).sum())))
    return out


def label_words(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): for each row the runs of words of one label as (first, last + 1, lang, score), places in code points of the lower-cased text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def spans(m: LangModel, text: str) -> list[dict]:
        w = words_of([text], m.params)
        if not len(w.starts) or not m.labels:
            return []
        post = m.posteriors(w)
        best = post.argmax(1)
        turn = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        stop = np.append(turn[1:], len(best))
        return [{"first": int(w.starts[a]) - 1, "last": int(w.ends[b - 1]) - 1, "lang": m.labels[best[a]], "score": float(post[a:b, best[a]].mean())} for a, b in zip(turn, stop, strict=True)]

    def make():
        m = held.value
        return lambda texts: [(spans(m, t or ""),) for t in texts]

    return common.map_texts(docs, make, "spans array<struct<first: long, last: long, lang: string, score: double>>", id_col, text_col)
