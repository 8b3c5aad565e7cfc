import re
from collections import Counter

import pytest
from arbora.llm import phrases
from arbora.llm.phrases import PhraseParams


def brute(rows, p):
    f, n = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, p.longest + 1) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x) > 2 and a >= p.least}
    out = {}
    for (lang, *w), a in cand.items():
        if any(100 * b >= p.inside * a and y[0] == lang and len(y) > len(w) + 1 and any(list(y[i : i + len(w)]) == w for i in range(1, len(y))) for y, b in cand.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in out.items() for i, x in enumerate(sorted(own)[: p.top], 1))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark, rng):
    words = ["New", "york", "city", "Ünï", "the", "of", "日本", "x"]
    rows = []
    for _ in range(400):
        text = " ".join(rng.choice(["new york city", "the of", "ünï x x x x", *words]) + rng.choice(["", "", "", ",", ". ", "\t", "\n", "\r\n", "  ", "\x0b", "-"]) for _ in range(30))
        rows.append((rng.choice(["en", "de", "", None, "und"]), text))
    df = spark.createDataFrame(rows, "lang string, text string")
    for p in (PhraseParams(), PhraseParams(least=3, top=15), PhraseParams(least=2, longest=3, inside=50)):
        want = brute(rows, p)
        assert got(phrases.top_phrases(df, p)) == want and want


def test_steps_between_pieces(spark, monkeypatch):
    """A text of many steps, a piece longer than a step, and documents that end within a step, count like whole ones."""
    texts = ["a b c d. " * 300, "a b c d " * 300, "", "x", "a b c d", "b c\nd a " * 50]
    whole = Counter()
    for x in texts:
        for k in (1, 2, 3):
            names, n = phrases.counted("en", x.encode(), k, all_ones())
            whole.update(dict(zip([(k, y) for y in names.to_pylist()], n.tolist(), strict=True)))
    monkeypatch.setattr(phrases, "STEP", 50)
    parts = Counter()
    for raw in phrases.steps([x.encode() for x in texts]):
        assert len(raw) <= 2450
        for k in (1, 2, 3):
            names, n = phrases.counted("en", raw, k, all_ones())
            parts.update(dict(zip([(k, y) for y in names.to_pylist()], n.tolist(), strict=True)))
    assert parts == +whole or {k: v for k, v in parts.items() if v} == {k: v for k, v in whole.items() if v}


def all_ones():
    import numpy as np

    return np.full(1 << (phrases.SIEVE_BITS - 6), (1 << 64) - 1, np.uint64)


def test_sieve_keeps_all_and_drops_most(spark):
    import numpy as np
    from arbora.llm import common

    held = [("en", f"w{i} v{i}") for i in range(500)]
    sieve = phrases._sieve(spark.createDataFrame([*held, ("de", "ä b")], "lang string, phrase string"), 2)

    def known(lang, x):
        words = common.word_hashes([x], "space")[0]
        return phrases._bit(sieve, phrases._hashes(words, 2, lang))[0]

    assert all(known(*x) for x in held) and known("de", "ä b")
    assert sum(known("fr", x) for _, x in held) < 3 and int(np.bitwise_count(sieve).sum()) <= 501


def test_odd_documents(spark, odd_docs, no_docs):
    p = PhraseParams(least=2)
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert got(phrases.top_phrases(odd_docs, p)) == brute(rows, p)
    assert phrases.top_phrases(no_docs).collect() == []


@pytest.mark.parametrize("a, l, r", [(30, 31, 32), (10**12, 3 * 10**12, 10**12 + 1), (7, 7, 7)])
def test_exact_scores(spark, a, l, r):
    table = spark.createDataFrame([("en", "a", 1, l), ("en", "b", 1, r), ("en", "a b", 2, a)], "lang string, phrase string, k int, f long")
    assert phrases.scored(table).first()["score"] == 2_000_000 * a // (l + r)
