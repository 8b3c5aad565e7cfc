import numpy as np
import pytest
from arbora.llm import common, langid, quality, toxicity
from conftest import WORDS, prose
from pyspark.sql import functions as F


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fold(spark):
    import zlib

    rows = spark.range(50).select("id", common.fold(F.col("id"), 4).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 for r in rows]


def test_toxicity_held_out(spark, rng):
    bad = ["villain", "rascal", "scoundrel", "buffoon"]
    rows = []
    for i in range(400):
        words = prose(rng).split()
        for _ in range(3 * (i % 4 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(docs.where("doc_id < 250"), labels_of(spark, [(i, 1, y) for i, _, y in rows if i < 250]))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in rows if i >= 250]) > 0.97


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    model = toxicity.train(odd_docs, labels_of(spark, []))
    assert {r.score for r in toxicity.score(odd_docs, model).collect()} == {0.5}
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels_of(spark, []))).collect() == []
    model = toxicity.train(odd_docs, labels_of(spark, [(2, 1, 1), (3, 1, 0), (5, None, None), (None, 1, 1)]))
    assert toxicity.score(odd_docs, model).count() == 10


def test_prior_and_quality(spark, rng):
    rows = []
    for i in range(500):
        good = i % 5 != 0
        rows.append((i, prose(rng, rng.choice(list(WORDS))) if good else " ".join(rng.choice("$$$ %%% ###".split()) + w.upper() for w in prose(rng).split()), int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality.train(docs.where("doc_id < 350"), labels_of(spark, [(i, y, 0) for i, _, y in rows if i < 350 and i % 2]))
    assert 0.65 < model.prior < 0.95
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if i >= 350]) > 0.95


def test_class_prior():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for prior in (0.2, 0.5, 0.8):
        mixed = np.concatenate([rng.normal(2, 1, int(4000 * prior)), neg[: int(4000 * (1 - prior))]])
        cuts = np.sort(pos)
        above = np.array([(mixed >= c).sum() for c in cuts])
        assert abs(quality.class_prior(cuts, above, len(mixed), 0.1) - prior) < 0.08


def test_prior_counts_every_row(spark, rng):
    """The tail shares behind the prior against a loop over all rows."""
    good, bad = [prose(rng) for _ in range(60)], [" ".join("$$ ##".split() * 20) for _ in range(40)]
    texts = spark.createDataFrame(list(enumerate(good + bad)), "id long, text string")
    sample = texts.where("id % 2 = 0").toPandas()
    p = quality.QualityParams(epochs=10)
    got = quality.estimated_prior(texts, good[:30], sample, p)
    model = quality.fit(good[:30][::2], sample["text"].iloc[::2].tolist(), 0.5, p)
    rest = [t for i, t in enumerate(good + bad) if i not in set(sample["id"].iloc[::2])]
    cuts, all_ = np.sort(model.margins(good[:30][1::2])), model.margins(rest)
    want = quality.class_prior(cuts, np.array([(all_ >= c - 1e-9).sum() for c in cuts]), len(rest), p.delta)
    assert abs(got - want) < 1e-9


def test_risk_against_a_grid():
    """On one feature, the minimiser errs hardly more than the best cut that knows all labels."""
    rng = np.random.default_rng(4)
    pos, good, bad = rng.normal(1.5, 1, (600, 1)), rng.normal(1.5, 1, (400, 1)), rng.normal(-1.5, 1, (400, 1))
    w, b = quality.risk_minimiser(pos, np.concatenate([good, bad]), 0.5, quality.QualityParams(epochs=200))

    def wrong(x, y):
        return ((good[:, 0] * x + y < 0).mean() + (bad[:, 0] * x + y >= 0).mean()) / 2

    assert wrong(w[0], b) <= min(wrong(1, -c) for c in np.linspace(-3, 3, 121)) + 0.02


def test_ratios_against_counting(spark, rng):
    """Log-count ratios of n-grams against counting them in dictionaries, and the fit's gradient at its end."""
    p = toxicity.ToxicityParams(orders=(3,), min_z=1.0)
    rows = [(i, i % 2, prose(rng, "en" if i % 2 else "de", 12)) for i in range(60)]
    seen, size = [{}, {}], 1 << p.bits
    for _, y, t in rows:
        for g in set(toxicity.buckets(t, p).tolist()):
            seen[y][g] = seen[y].get(g, 0) + 1
    total = [sum(s.values()) + p.smoothing * size for s in seen]
    want = {}
    for g in {*seen[0], *seen[1]}:
        a, b = (s.get(g, 0) + p.smoothing for s in seen)
        r = np.log(b / total[1]) - np.log(a / total[0])
        if r * r >= p.min_z**2 * (1 / a + 1 / b):
            want[g] = r
    got = toxicity.ratios(spark.createDataFrame(rows, "id long, y int, text string"), p)
    assert dict(zip(got["bucket"], got["r"].round(9))) == {g: round(r, 9) for g, r in want.items()}


def test_string_ids_and_large_ids(spark, rng):
    rows = [(f"doc-{i}", prose(rng) + (" villain rascal" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, y int")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id string, quality int, toxic int")
    for op in (toxicity, quality):
        assert {r.doc_id for r in op.score(docs, op.train(docs, labels)).collect()} == {r[0] for r in rows}
        big = spark.createDataFrame([(9007199254740993, "a"), (None, "b")], "doc_id long, text string")
        assert {r.doc_id for r in op.score(big, op.train(docs, labels)).collect()} == {9007199254740993, None}


def test_quality_odd(spark, odd_docs, no_docs):
    model = quality.train(odd_docs, labels_of(spark, [(5, 1, 0), (2, 0, 0)]))
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    empty = quality.train(no_docs, labels_of(spark, []))
    assert quality.score(no_docs, empty).collect() == []
    assert {r.score for r in quality.score(odd_docs, empty).collect()} == {0.5}


SMALL = langid.LangParams(chains=300, rounds=25, sample_rows=60)


@pytest.fixture(scope="module")
def model():
    import random

    rng = random.Random(3)
    texts = [(prose(rng, lang), lang) for lang in WORDS for _ in range(60)]
    return langid.fit(*map(list, zip(*texts)), SMALL)


def test_languages(spark, rng, model):
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate([*WORDS] * 20)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.97


def test_code_switching(spark, rng, model):
    text = prose(rng, "en", 25) + " " + prose(rng, "fr", 25)
    spans = langid.label_words(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert spans[1].spans == []
    size = {"en": 0, "fr": 0, "de": 0}
    for s in spans[0].spans:
        size[s.lang] += s.last - s.first
    half = len(text) / 2
    assert abs(size["en"] - half) < 0.25 * half and abs(size["fr"] - half) < 0.25 * half


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    cuts = np.array([0, 4, 4, 7])
    grid, used = langid.chain_grid(cuts, 64)
    post, expected = langid.forward_backward(e, grid, used, t, counts=True)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        total, own, own_p = 0, np.zeros((7, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(e[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                own[a + i, y] += w
            for x, y in itertools.pairwise(path):
                own_p[x, y] += w
        want += own / total
        pairs += own_p / total
    assert np.allclose(post, want) and np.allclose(expected, pairs)


def test_long_chains_are_not_cut():
    """A chain of 200 code-switched words in spans of 64 against one uncut forward-backward."""
    rng = np.random.default_rng(1)
    e = np.repeat(rng.normal(size=(10, 4)), 20, axis=0) + rng.normal(size=(200, 4))
    e, t, cuts = np.vstack([e, rng.normal(size=(130, 4))]), rng.normal(size=(4, 4)), np.array([0, 200, 200, 264, 330])
    grid, used = langid.chain_grid(cuts, 64)
    got = langid.forward_backward(e, grid, used, t, chain=np.searchsorted(cuts, grid[:, 0], side="right") - 1)[0]
    want = langid.forward_backward(e, *langid.chain_grid(cuts, 1000), t)[0]
    assert np.allclose(got, want)


def test_language_odd(spark, odd_docs, no_docs, model):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()]
    assert {(i, p) for i, p, _ in got if p == "und"} == {(1, "und"), (2, "und"), (3, "und"), (7, "und")}
    assert len(got) == 10 and all(0 <= s <= 1 for _, _, s in got)
    none = langid.train(no_docs, SMALL)
    assert {r.lang_pred for r in langid.predict(odd_docs, none).collect()} == {"und"}
    assert langid.predict(no_docs, none).collect() == []
