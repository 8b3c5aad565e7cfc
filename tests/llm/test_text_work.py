import re
import hashlib
import zlib

import numpy as np
import pytest
from arbora.llm import common, isomedia, pii, suffix
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

TEXTS = st.text(alphabet="aAbÄß \t\n\x00.7日", max_size=40)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(st.lists(TEXTS, max_size=8))
@settings(deadline=None)
def test_word_hashes(texts):
    for word, pattern in (("space", "[^\\x20\\x09-\\x0D]+"), ("alnum", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")):
        want = [re.findall(pattern, t.translate(LOWER)) for t in texts]
        got = common.word_hashes(texts, word)
        assert [len(g) for g in got] == [len(w) for w in want]
        names = {}
        for g, w in zip(got, want, strict=True):
            for h, x in zip(g.tolist(), w, strict=True):
                assert names.setdefault(h, x) == x
        assert len(names) == len({x for w in want for x in w})


# --- media -----------------------------------------------------------------------------------


@given(st.binary(max_size=4000))
@settings(deadline=None, max_examples=40)
def test_media_round_trip(raw):
    data = isomedia.store(isomedia.filled(raw, 576))
    (t,) = isomedia.parse(data)
    read = isomedia.payload(data, t)
    assert read.startswith(raw) and len(read) % 576 == 0 and set(read[len(raw) :]) <= {255} and len(read) - len(raw) < 577
    assert (t.codec, t.handler, t.timescale, t.duration) == ("raw ", "vide", 25, len(read) // 576)
    for number, time, first, size in t.key_ranges():
        assert (number - 1) % 12 == 0 and time == number - 1 and data[first : first + size] == read[(number - 1) * 576 : number * 576]


def test_media_many_samples():
    raw = bytes(range(256)) * 9 * 40
    data = isomedia.store(raw, isomedia.Layout(samples_per_chunk=7, key_every=5))
    (t,) = isomedia.parse(data)
    assert isomedia.payload(data, t) == raw and len(t.keys) == -(-len(t.sizes) // 5)


def test_media_foreign(spark):
    """Large box sizes, 64-bit offsets, a size table, unknown boxes, no sync table, a box that reaches to the end."""
    box, full = isomedia._box, isomedia._full
    pack = __import__("struct").pack

    def moov(base):
        stbl = box(b"stbl", full(b"stsd", pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stts", pack(">IIIII", 2, 2, 10, 1, 5)), full(b"stsc", pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", pack(">IIIII", 0, 3, 3, 4, 5)), full(b"co64", pack(">IQQ", 2, base, base + 9)))
        mdia = box(b"mdia", full(b"mdhd", pack(">QQIQ", 0, 0, 1000, 25) + bytes(4), flags=1 << 24), full(b"hdlr", bytes(4), b"soun", bytes(13)), box(b"minf", stbl))
        return box(b"moov", box(b"free", b"x"), box(b"trak", full(b"tkhd", pack(">IIIII", 0, 0, 7, 0, 0) + bytes(60)), mdia))

    head = pack(">I4sQ", 1, b"junk", 20) + b"abcd"
    base = len(head) + len(moov(0)) + 8
    data = head + moov(base) + pack(">I4s", 0, b"mdat") + b"AAABBBB--CCCCC"
    rows = isomedia.tracks(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-1])), (3, None), (4, bytearray(b"abc")), (1, bytearray(data))], "doc_id long, media binary")).collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) == 4 and len(good) == 2 and sorted(r.doc_id for r in rows if r.error) == [2, 4]
    r = good[0]
    assert (r.track_id, r.handler, r.codec, r.duration, r.seconds, r.n_samples) == (7, "soun", "mp4a", 25, 0.025, 3)
    assert [(k["sample"], k["time"], k["first"] - base, k["bytes"]) for k in r.key_frames] == [(1, 0, 0, 3), (2, 10, 3, 4), (3, 20, 9, 5)]
    (t,) = isomedia.parse(data)
    assert isomedia.payload(data, t) == b"AAABBBBCCCCC"


def test_media_hostile(spark):
    """Empty boxes, deep nesting, sample counts beyond the container: an error row, null digests, never a crash."""
    box, full = isomedia._box, isomedia._full
    pack = __import__("struct").pack
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    stbl = box(b"stbl", full(b"stsd", pack(">I", 0)), full(b"stsz", pack(">II", 8, 2**32 - 1)), full(b"stco", pack(">I", 0)), full(b"stsc", pack(">I", 0)), full(b"stts", pack(">I", 0)))
    mdia = box(b"mdia", full(b"mdhd", bytes(20)), full(b"hdlr", bytes(12)), box(b"minf", stbl))
    vast = box(b"moov", box(b"trak", full(b"tkhd", bytes(80)), mdia))
    media = spark.createDataFrame([(1, bytearray(box(b"moov", box(b"trak", box(b"tkhd"))))), (2, bytearray(deep)), (3, bytearray(vast)), (4, None), (5, bytearray(box(b"free", b"x"))), (9007199254740993, None)], "doc_id long, media binary")
    assert sorted(r.doc_id for r in isomedia.tracks(media).where("error is not null").collect()) == [1, 2, 3]
    got = isomedia.digests(media, keep=()).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 9007199254740993] and all(r.payload_sha256 is None for r in got)


def _container(sizes_box, offset, samples):
    """One chunk of `samples` samples whose first is said to lie at offset."""
    box, full, pack = isomedia._box, isomedia._full, __import__("struct").pack
    stbl = box(b"stbl", full(b"stsd", pack(">I", 0)), full(b"stts", pack(">III", 1, samples, 1)), full(b"stsc", pack(">IIII", 1, 1, samples, 1)), sizes_box, full(b"co64", pack(">IQ", 1, offset)))
    mdia = box(b"mdia", full(b"mdhd", bytes(20)), full(b"hdlr", bytes(12)), box(b"minf", stbl))
    return box(b"mdat", b"abcdefghijklmnop") + box(b"moov", box(b"trak", full(b"tkhd", bytes(80)), mdia))


@pytest.mark.parametrize("offset", [2**63, 2**64 - 1, 2**63 - 1, 2**32, 10**6])
def test_media_offsets_beyond_the_file(offset):
    sizes = isomedia._full(b"stsz", __import__("struct").pack(">IIIII", 0, 3, 3, 4, 5))
    (t,) = isomedia.parse(_container(sizes, 8, 3))
    assert isomedia.payload(_container(sizes, 8, 3), t) == b"abcdefghijkl"
    with pytest.raises(isomedia.BadMedia):
        isomedia.parse(_container(sizes, offset, 3))


def test_media_compact_sizes_and_fragments(spark):
    box, full, pack = isomedia._box, isomedia._full, __import__("struct").pack
    for bits, table in ((4, b"\x34\x50"), (8, b"\3\4\5"), (16, b"\0\3\0\4\0\5")):
        data = _container(full(b"stz2", bytes(3), bytes([bits]), pack(">I", 3), table), 8, 3)
        (t,) = isomedia.parse(data)
        assert t.sizes.tolist() == [3, 4, 5] and isomedia.payload(data, t) == b"abcdefghijkl"
    with pytest.raises(isomedia.BadMedia):
        isomedia.parse(_container(full(b"stz2", bytes(3), b"\5", pack(">I", 3), b"\3\4\5"), 8, 3))
    with pytest.raises(isomedia.BadMedia):
        isomedia.parse(_container(full(b"stz2", bytes(3), b"\4", pack(">I", 30), b"\3\4\5"), 8, 3))
    whole = _container(full(b"stsz", pack(">II", 4, 3)), 8, 3)
    media = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole + box(b"moof", box(b"traf"))))], "doc_id long, media binary")
    assert {r.doc_id: r.error for r in isomedia.tracks(media).collect()} == {1: None, 2: "the file is fragmented"}


def test_media_query_columns(spark, odd_docs, no_docs):
    rows = isomedia.digests(isomedia.to_media(odd_docs)).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    want = {}
    for i, t in texts:
        p = isomedia.filled((t or "").encode(), 576)
        want.setdefault(i, set()).add((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert len(rows) == 10
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[None if r.doc_id is None or r.doc_id != r.doc_id else r.doc_id]
    assert isomedia.digests(isomedia.to_media(no_docs)).collect() == []


# --- suffix arrays ---------------------------------------------------------------------------


def brute_hits(docs, items, window=13):
    pattern = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    parts = [(str(i) if i is not None else "", pattern.findall((t or "").translate(LOWER))) for i, t in items]
    out = []
    for i, t in docs:
        w = pattern.findall((t or "").translate(LOWER))
        hit, names = set(), []
        for name, x in parts:
            k = min(window, len(x))
            found = {a for s in range(len(x) - k + 1) if k for a in range(len(w) - k + 1) if w[a : a + k] == x[s : s + k]}
            hit |= {p for a in found for p in range(a, a + k)}
            if found:
                names.append(name)
        out.append((i, len(w), len(hit), len(names), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases(rng):
    items = [(i, prose(rng, "en", 30 + i)) for i in range(6)] + [(10, "Just three words"), (11, "solo"), (12, ""), (13, None), (2, prose(rng, "en", 30))]
    docs = []
    for i in range(40):
        text = prose(rng, "en", 60).split()
        if i % 4 == 1:
            w = items[i % 6][1].split()
            a = rng.randrange(10)
            text[20:20] = w[a : a + rng.choice([12, 13, 14, 25])]
        if i % 9 == 2:
            text[5:5] = ["just", "THREE", "words"]
        docs.append((i, " ".join(text)))
    return items, docs + [(50, ""), (51, None), (52, "solo"), (53, "a b")]


def test_contamination_against_brute_force(spark, rng):
    items, docs = cases(rng)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    for p in (suffix.SuffixParams(), suffix.SuffixParams(block_words=40, shard_words=100)):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in suffix.contamination(d, b, p).collect()), key=repr)
        assert got == want
    assert {r.doc_id for r in suffix.clean(d, b).collect()} == {x[0] for x in want if not x[5]}
    found = suffix.matches(d, b).where("item = '1'").collect()
    words = {i: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(LOWER)) for i, t in docs}
    item = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", items[1][1].translate(LOWER))
    assert found and all(r.length >= 13 and words[r.doc_id][r.place : r.place + r.length] == item[r.item_place : r.item_place + r.length] for r in found)


@given(st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_longest_matches_against_brute_force(seed):
    """Texts of few different words, so that matches overlap and repeat: lengths, suffixes and items of each place."""
    r = np.random.default_rng(seed)
    kinds, p = int(r.integers(1, 4)), suffix.SuffixParams(window=int(r.integers(2, 6)), lead=int(r.integers(1, 4)))
    docs = [common.mix64(r.integers(1, kinds + 1, r.integers(0, 40)).astype(np.uint64)) for _ in range(4)]
    items = suffix.TestItems(p, ["a", "b", "c"], [common.mix64(r.integers(1, kinds + 1, r.integers(1, 25)).astype(np.uint64)) for _ in range(3)])

    class Early(suffix.Shard):
        WORDWISE = 2

    for shard in (suffix.Shard(docs, items), Early(docs, items)):
        want, names = {}, [set() for _ in docs]
        for d, doc in enumerate(docs):
            for a in range(len(doc)):
                best = []
                for j in range(len(items.start)):
                    x, y, n = doc[a:], items.flat[items.start[j] : items.stop[j]], 0
                    while n < min(len(x), len(y)) and x[n] == y[n]:
                        n += 1
                    best.append(n if n >= items.need[j] else 0)
                    if best[-1]:
                        names[d].add(int(items.item[j]))
                if any(best):
                    want[int(shard.first[d]) + a] = (max(best), best.index(max(best)))
        place, length, own, got = shard.longest(items)
        assert {a: (n, j) for a, n, j in zip(place.tolist(), length.tolist(), own.tolist(), strict=True)} == want and got == names


def test_repetitive_text_needs_little_memory():
    import tracemalloc

    one = common.mix64(np.ones(60_000, np.uint64))
    items = suffix.TestItems(suffix.SuffixParams(), ["x"], [one[:400]])
    tracemalloc.start()
    place, length, _, names = suffix.Shard([one], items).longest(items)
    assert len(place) == 60_000 - 12 and length.max() == 400 and names == [{0}] and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_contamination_odd(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "another word word and another"), (None, "one"), (3, None)], "item_id long, text string")
    rows = suffix.contamination(odd_docs, b).collect()
    assert len(rows) == 10 and {r.n_hit for r in rows if r.doc_id in (5, 6)} == {1} and max(r.n_hit for r in rows) == 119_997  # all but two words at the start and one at the end
    assert suffix.contamination(no_docs, b).collect() == []
    assert not any(r.contaminated for r in suffix.contamination(odd_docs, b.limit(0)).collect())


# --- personal data ---------------------------------------------------------------------------

PII = st.text(alphabet="a1.@+- ()", max_size=60)


@given(PII)
@settings(deadline=None, max_examples=300)
def test_seeds_against_plain_patterns(text):
    def plain(pattern):
        return [(m.start(), m.end()) for m in re.finditer(pattern, text)]

    digits = lambda a, b: re.sub("[^0-9]", "", text[a:b])
    want = [("email", *x) for x in plain(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    want += [("ip", a, b) for a, b in plain(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in text[a:b].split("."))]
    want += [("card", a, b) for a, b in plain(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(a, b)) <= 19 and pii.luhn(digits(a, b))]
    want += [("phone", a, b) for a, b in plain(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(a, b)) <= 15]
    assert pii.seeds(text) == want


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_bootstrapping_finds_unseen_identifiers(spark, rng):
    rows = [(i, f"{prose(rng)} mailto user{i}@host{i}.example.org now") for i in range(12)]
    rows += [(20, "Please mailto anna(at)firm.example today"), (21, "Call 2024 anna(at)firm.example or room 12345 now"), (22, "a plain number 99999 here")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i].base) == 1 and got[i].base[0].kind == "email" and got[i].found == [] for i in range(12))
    for i in (20, 21):
        (f,) = got[i].found
        assert f.kind == "email" and rows[-3 + i - 20][1][f.first : f.end] == "anna(at)firm.example"
    assert got[22].found == []


def test_secrets_and_contexts(spark, rng):
    """Seeds of one shape teach the word that values are assigned to; values of other shapes follow, other numbers don't."""
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'{prose(rng)} token = "{key(i)}" {prose(rng, "de", 5)}') for i in range(10)]
    rows += [(20, f'{prose(rng)} token = "zz-9911-{"q" * 20}", {prose(rng)}'), (21, "token = 12345"), (22, f"order {'9' * 20} of the day"), (23, "ring 030 12 34 56 78 now")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(10):
        (f,) = got[i].found
        assert f.kind == "secret" and f.seed and rows[i][1][f.first : f.end] == key(i)
    (f,) = got[20].found
    assert f.kind == "secret" and not f.seed and rows[10][1][f.first : f.end] == "zz-9911-" + "q" * 20
    assert got[21].found == got[22].found == got[23].found == []
    text = rows[-1][1]
    assert [text[a:b] for a, b in pii.candidates(text, [])] == ["030 12 34 56 78"]


def test_context_words_are_whole():
    long = "w" * 5000
    text = f"{long} {long}x 1234 {long}y"
    a = text.index("1234")
    assert pii.context(text, a, a + 4) == [f"L {long}x", f"LL {long} {long}x", f"R {long}y"]


def test_bootstrap_against_brute_force(spark, rng):
    """Rounds of confidences and scores against dictionaries."""
    words = ["call", "mail", "id", "at", "to"]
    mentions = [(k, f"{v:07d}", [f"L {rng.choice(words)}", f"R {rng.choice(words)}"]) for v in range(60) for k in [rng.choice(["phone", None, None])] for _ in range(2)]
    p = pii.PiiParams(min_confidence=0.3, min_score=0.4)
    found, _ = pii.bootstrap(spark.createDataFrame(mentions, "kind string, value string, patterns array<string>"), p)
    graph = {(x, v) for _, v, ps in mentions for x in ps}
    known = {v for k, v, _ in mentions if k}
    score, was = dict.fromkeys(known, 1.0), None
    while score != was:
        was, conf = score, {}
        for x in {x for x, _ in graph}:
            own = [v for y, v in graph if y == x]
            s = [score[v] for v in own if v in score]
            if len(s) >= p.min_support and round(sum(s) / (len(own) + p.smoothing), 6) >= p.min_confidence:
                conf[x] = round(sum(s) / (len(own) + p.smoothing), 6)
        score = dict.fromkeys(known, 1.0)
        for v in {v for _, v in graph} - known:
            miss = np.prod([1 - conf[x] for x, y in graph if y == v and x in conf])
            if round(1 - miss, 6) >= p.min_score:
                score[v] = round(1 - miss, 6)
    want = {v: s for v, s in score.items() if v not in known}
    got = {r.value: r.score for r in found.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-3 for v in want)


def test_pii_odd(spark, odd_docs, no_docs):
    rows = pii.extract(odd_docs).collect()
    assert len(rows) == 10 and all(r.base == [] and r.found == [] for r in rows)
    assert pii.extract(no_docs).collect() == []
    huge = spark.createDataFrame([(1, "1" * 50_000 + " " + "a" * 50_000 + "@ " + "9." * 20_000)], "doc_id long, text string")
    assert pii.extract(huge).count() == 1
