import itertools
import re
from collections import Counter

import duckdb
import numpy as np
from arbora.llm import lines, minhash, mixing, urls
from conftest import prose
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- near duplicates -------------------------------------------------------------------------


def sets_of(rows, k):
    out = []
    for i, t in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(LOWER))
        out.append((i, {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def brute_components(rows, k):
    sets = sets_of(rows, k)
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((top(i), top(j)))
            up[y] = x
    return sorted((i, len(s), top(i), i == top(i)) for i, s in sets)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(10**6))
    return " ".join(w)


def corpus(rng):
    rows = []
    for g in range(12):
        base = prose(rng, "en", 80)
        rows += [base] + [edited(rng, base, n) for n in (0, 0, 1, 2, 3, 4, 6, 9)]
    hub = prose(rng, "de", 200)
    rows += [edited(rng, hub, rng.randrange(1, 12)) for _ in range(60)] + [hub.upper(), "", "   ", None, "lone", "LONE", "two words", "two  words"]
    rng.shuffle(rows)
    return [(100 + 3 * i, t) for i, t in enumerate(rows)]


def test_components_against_brute_force(spark, rng):
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (minhash.MinHashParams(shingle=2), minhash.MinHashParams(), minhash.MinHashParams(shingle=2, block=4), minhash.MinHashParams(shingle=2, block_shingles=300, bin_rows=50)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs, p).collect())
        assert got == brute_components(rows, p.shingle)


def test_blocks_without_hubs(spark, rng):
    """Blocks alone find all links: each class begins as its own component."""
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = minhash.MinHashParams(shingle=2, block=16)
    every = minhash.sketches(docs, p, "doc_id", "text").where("n > 0")
    classes = every.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).cache()
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = members.groupBy("key").agg(F.max("id").alias("hub"))
    sets = minhash.full_sets(docs, classes, p, "doc_id", "text")
    links = minhash.rest_links(members, hubs, spark.createDataFrame([], "id long, root long"), classes, sets, p)
    roots = {r.id: r.root for r in minhash.star_components(links).collect()}
    want = {i: c for i, n, c, _ in brute_components(rows, 2)}
    for r in classes.select("id").collect():
        first = roots.get(r.id, r.id)
        assert want[first] == want[r.id] and (first == r.id or want[r.id] <= first)
    assert len({*roots.values()}) == len({want[r.id] for r in classes.select("id").collect() if r.id in roots})


def test_star_components(spark, rng):
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {v: v for e in edges for v in e}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.id: r.root for r in minhash.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for v in linked}
    assert minhash.star_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_minhash_estimates():
    a, b = minhash.hashers(minhash.MinHashParams())
    x, y = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(250, 1250, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert abs((minhash.minima(x, a, b) == minhash.minima(y, a, b)).mean() - 0.6) < 0.12


def test_near_odd(spark, odd_docs, no_docs):
    rows = minhash.components(odd_docs).collect()
    got = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert len(rows) == 10 and {(2, 2, True), (3, 3, True), (5, 5, True), (6, 5, False), (1, 1, True)} <= got
    assert minhash.deduplicated(odd_docs).count() == 9 and minhash.deduplicated(odd_docs).columns == odd_docs.columns
    assert minhash.components(no_docs).collect() == []


# --- mixing ----------------------------------------------------------------------------------


def targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        share = {s: (total - sum(full.values())) * w[s] / sum(w[x] for x in rest) for s in rest} if rest else {}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**share, **full}
        full |= {s: 2 * sizes[s] for s in over}


def test_mix(spark, rng):
    rows = [(i, prose(rng, "en", rng.randrange(1, 60)), rng.choice(["b", "a", "ü", None, "c"] if i % 3 else ["a"])) for i in range(1500)] + [(5000, None, "empty"), (5001, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.MixParams(block=64)
    got = mixing.mix(docs, p).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken % max(r["size"], 1) == 0 and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7), p).collect()))


def test_flight_keeps_totals(rng):
    size, prob = [rng.randrange(1, 500) for _ in range(400)], [0.37] * 400
    out = mixing.flight(size, prob, np.random.default_rng(1))
    assert sum(1e-9 < x < 1 - 1e-9 for x in out) <= 2
    assert abs(sum(out) - sum(prob)) < 1e-6 and abs(np.dot(size, out) - np.dot(size, prob)) < 1e-4
    mean = np.mean([mixing.flight(size[:12], [0.3] * 12, np.random.default_rng(i)) for i in range(800)], axis=0)
    assert abs(mean - 0.3).max() < 0.07  # inclusion probabilities hold


def test_mix_keeps_ids_at_fractional_targets(spark):
    """Ids beyond 2**53 beside null ones, in sources that aren't taken a whole number of times."""
    big = 9007199254740993
    rows = [(None if k % 7 == 0 else big + 2 * k, "w " * (1 + k % 40), s) for k in range(300) for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {(r.target / r.source_size) % 1 > 0 for r in got} >= {True}
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_landing_makes_up_for_long_documents(spark):
    """One document of a third of all words is taken or not; the rest is turned until the total is near."""
    rows = [(k, "w " * (20 + k % 13), s) for s, first in (("a", 0), ("b", 5000), ("c", 10000)) for k in range(first, first + 1500)] + [(99_999, "w " * 15_000, "a"), (99_998, "w " * 9_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for p in (mixing.MixParams(), mixing.MixParams(block=256, reserve=1000, seed=4)):
        got = mixing.mix(docs, p).collect()
        for s in "abc":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) < 0.001 * own[0].target
            assert all(r.taken <= 2 * r.size for r in own)


def test_mix_odd(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(no_docs).collect() == []
    assert {r.taken for r in mixing.mix(odd_docs.where("doc_id in (1, 2, 3)")).collect()} == {0}


# --- URLs ------------------------------------------------------------------------------------


def test_urls_against_sql(spark, rng):
    hosts = ["a.example.org", "example.org", "News.example.com", "shop.example.com", "x.example.net", "org", "norg", "com"]
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es', 'en/1'])}/{rng.choice(['item', 'tag', 'p' + str(i % 7)])}/{rng.randrange(10**6)}{rng.choice(['', '?q=1', '#top', '.html', '/'])}") for i in range(600)]
    rows += [(2000 + i, f"http://deep.example.com/{'fr' if i % 2 else 'de'}/a/b/c/d/{'e' if i % 3 else 'f'}/g{i % 2}/h") for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme/here"), (1003, "http://"), (1004, "http://example.org?x=/es/"), (1005, "ftp://EXAMPLE.org/es/A"), (1005, "ftp://EXAMPLE.org/es/A"), (None, "http://a.com/de/1://b")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = urls.judged(pages)
    con = duckdb.connect()
    con.register("t", pages.toPandas())
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT AS page_id, url FROM t")
    names = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    key = lambda r: tuple(map(repr, r))
    want = con.execute(f"SELECT {', '.join(names)} FROM ({urls.sql()})").fetchall()
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(want, key=key)
    by = {r.page_id: r for r in got.collect()}
    assert (by[1005].host, by[1005].rule, by[1005].verdict) == ("example.org", "example.org/es/", "block")
    assert (by[1004].path, by[1004].rule, by[1000].host, by[1002].path) == ("", None, "", "")


def test_tree_learns(spark):
    """On one host, a branch that rules block and one that they allow judge unruled URLs of the same templates."""
    rules = (("com", "/shop/a", "block"), ("com", "/news/a", "allow"))
    rows = [f"http://x.com/{k}/{s}{i}" for k in ("shop", "news") for s in "ab" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.path: r.verdict for r in urls.judged(pages, urls.UrlParams(rules=rules)).collect()}
    assert got["/shop/b7"] == "block" and got["/news/b7"] == "allow"


def test_deep_templates(spark):
    """Rules that tell URLs apart from the sixth segment on judge unruled ones of the same templates."""
    rules = tuple(("com", f"/a/b/c/d/e/{k}/x", v) for k, v in (("shop", "block"), ("news", "allow")))
    pages = spark.createDataFrame(list(enumerate(f"http://x.com/a/b/c/d/e/{k}/{s}{i}" for k in ("shop", "news") for s in "xy" for i in range(40))), "page_id long, url string")
    got = {r.path: r.verdict for r in urls.judged(pages, urls.UrlParams(rules=rules)).collect()}
    assert got["/a/b/c/d/e/shop/y7"] == "block" and got["/a/b/c/d/e/news/y7"] == "allow"


def test_long_urls_against_sql(spark, rng, monkeypatch):
    """Paths of up to 1000 segments, with labels of one kind, of both or none, that end or part anywhere; few rounds."""
    rows = ["http://none.net/" + "s/" * 1000, "http://none.net/" + "s/" * 400 + "t", "http://x.com/de/" + "a/" * 600, "http://x.com/de/" + "a/" * 20, "http://y.com/fr/" + "b/" * 300]
    rows += [f"http://example.org/en/{i % 3}/" + "x/" * 200 + ("y" if i % 2 else "z/z/z") for i in range(30)]  # blocked and allowed under one template
    rows += [f"http://m.com/{rng.choice(['de', 'fr', 'it'])}/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(150)]
    rows += [f"http://example.org/{rng.choice(['es', 'en/1', 'en/2', 'pt'])}/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(5))) for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    steps, stats = [], urls._stats
    monkeypatch.setattr(urls, "_stats", lambda *a: steps.append(1) or stats(*a))
    got = urls.judged(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect()
    assert len(steps) <= 1 + 3 * 12
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(f"SELECT page_id, host, path, rule, verdict, template, purity FROM ({urls.sql()})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_urls_empty(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


# --- lines -----------------------------------------------------------------------------------


def mask(line):
    plain = re.sub("[ \t\n\x0b\f\r]+", " ", line).strip(" ")
    return re.sub("[^ ]*[0-9][^ ]*", "<*>", plain)


def brute_lines(docs, p):
    """Recurring masked lines; copies are told apart by whole documents, so only for corpora without near copies."""
    distinct = {t for t in docs if t}
    held = {}
    for t in distinct:
        for x in {mask(y) for y in t.split("\n")} - {""}:
            held.setdefault(x, set()).add(t)
    leaves = {}
    for x in held:
        w = x.split(" ")
        leaves.setdefault((len(w), *w[: p.lead]), []).append(x)
    name = {}
    for key, own in leaves.items():
        if len(own) < 2 or key[0] <= p.lead:
            continue
        docs_in = sum(len(held[x]) for x in own)
        constant = {}
        for i in range(p.lead, key[0]):
            votes = {}
            for x in own:
                votes[x.split(" ")[i]] = votes.get(x.split(" ")[i], 0) + len(held[x])
            best = max(votes.items(), key=lambda v: (v[1], v[0]))
            if 2 * best[1] >= docs_in:
                constant[i] = best[0]
        for x in own:
            w = x.split(" ")
            if sum(w[i] == c for i, c in constant.items()) >= p.min_constant * (key[0] - p.lead):
                name[x] = key
    count, tokens = {}, {}
    for x, d in held.items():
        k = name.get(x, x)
        count[k] = count.get(k, 0) + len(d)
        tokens[k] = len(x.split(" "))
    return {x for x in held if count[name.get(x, x)] >= (p.min_docs_long if tokens[name.get(x, x)] >= p.long_tokens else p.min_docs)}


def test_lines_against_brute_force(spark, rng):
    p = lines.LineParams()
    shared = prose(rng, "de", 60)
    texts = []
    for i in range(60):
        body = [prose(rng, "en", 25) for _ in range(4)]
        if i % 3 == 0:
            body.insert(rng.randrange(5), "Licensed under the Apache License, Version 2.0.")
        if i % 2 == 0:
            body.append(f"Posted by {rng.choice(['anna', 'bob', 'eve' + 'x' * i])} on day number {i} of the year, all rights reserved here")
        if i % 15 == 4:
            body.append(shared)
        if i % 20 == 3:
            body.append("seen three times only and short")
        texts.append("\n".join(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = brute_lines(texts, p)
    assert shared in gone and "Licensed under the Apache License, Version <*>" in gone and "seen three times only and short" not in gone
    got = {r.doc_id: r for r in lines.deduplicated(docs, p).collect()}
    for i, t in enumerate(texts):
        want = [x for x in t.split("\n") if mask(x) not in gone]
        assert got[i].text == "\n".join(want) and got[i].n_dropped == len(t.split("\n")) - len(want) and got[i].n_lines == len(t.split("\n"))


def test_copies_are_left_alone(spark, rng):
    base = [prose(rng, "en", 30) for _ in range(8)]
    rows = ["\n".join(base)] * 30
    for i in range(40):
        own = list(base)
        own[i % 8] = own[i % 8] + f" word{i}"
        rows.append("\n".join(own))
    got = lines.deduplicated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert got.agg(F.sum("n_dropped")).first()[0] == 0


def test_lines_in_a_large_family(spark, rng):
    """A copy family counts once, so it doesn't shield a line that unrelated documents hold as well."""
    passage, base = prose(rng, "de", 60), [prose(rng, "en", 30) for _ in range(4)]
    copies = ["\n".join([*base[:3], base[3] + f" word{i % 9}", passage]) for i in range(140)]
    others = ["\n".join([prose(rng, "fr", 40), passage, prose(rng, "fr", 40)]) for _ in range(20)]
    got = lines.deduplicated(spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")).collect()
    assert len(got) == 160 and all(passage not in r.text and r.n_dropped == 1 for r in got)


def test_passages_of_two_documents(spark, rng):
    """A long line of two unrelated documents goes, as does a passage that is broken into short lines; short ones stay."""
    line, parts, few = prose(rng, "de", 60), [prose(rng, "de", n) for n in (24, 20, 22, 4)], prose(rng, "de", 12)
    bodies = [[prose(rng, "en", 30) for _ in range(4)] for _ in range(30)]
    texts = [list(b) for b in bodies]
    for i in (3, 9):
        texts[i].insert(2, line)
    for i in (5, 11):
        texts[i][1:1] = parts
    for i in (6, 12, 18):
        texts[i].insert(3, few)
    for i in range(40):  # copies, near and exact, that hold no more than their own lines
        texts.append([*bodies[0][:3], bodies[0][3] + (f" word{i}" if i % 2 else "")])
    want = [[x for x in t if x != line and x not in parts] for t in texts]
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: "\n".join(t) for i, t in enumerate(want)}


def test_lines_keep_all_columns(spark, rng):
    names = ["_key", "key", "_text", "mark", "both", "left", "gone", "row", "lines", "body", "sig", "n_lines"]
    rows = [(i, prose(rng) + "\nAll rights reserved here\t today.", *([7] * len(names))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    got = lines.deduplicated(docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    assert all(r.n_dropped == 1 and r.n_lines == 2 and all(r[c] == 7 for c in names[:-1]) for r in got.collect())


def test_lines_odd(spark, odd_docs, no_docs):
    rows = lines.deduplicated(odd_docs).collect()
    texts = sorted((repr(r.text) for r in odd_docs.collect()))
    assert sorted(repr(r.text) for r in rows) == texts and set(lines.deduplicated(odd_docs).columns) == {*odd_docs.columns, "n_dropped"}
    assert lines.deduplicated(no_docs).collect() == []


def test_turned_hashes_are_made_once(spark):
    """The turned hashes of a line's pairs serve both their least and their greatest value: one turn in the plan beside that of neighbours."""
    df = spark.range(1).select(F.concat(F.lit("a b  c\td\ne f"), F.substring(F.col("id").cast("string"), 2, 1)).alias("text"))  # no constant
    marks = lines._marks(df, "text", lines.LineParams())
    assert marks._jdf.queryExecution().optimizedPlan().toString().count(" ^ ") == 2
    assert [r.x for r in marks.select(F.explode("_every").alias("x")).collect()] == ["a b c d", "e f"]
