import random
import re
from itertools import permutations

from arbora.llm import audit


def brute(docs, labels):
    """Applies each order to the documents of each part one after another. docs: (doc_id, text, source)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    rows = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, x in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]) if x}
        rows.setdefault(s or "", []).append((i, fails))
    out = []
    for part, own in rows.items():
        removed_over_all = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                here = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                removed_over_all[c] += len(here)
                steps.append(("".join(order), step, len(left), len(here), sum(c in x[1] for x in own) - len(here), sum(x[1] == {c} for x in own), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here), c))
        out += [(part, *s[:-1], removed_over_all[s[-1]]) for s in steps]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, 1, True, 5) for i, t, s in docs], "doc_id long, text string, source string, mask int, good boolean, n long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in audit.audit(d, lab).collect())


def test_against_applying_every_order(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["word", "Word", "WORD", "a|b", "x", "é", f"w{rng.randrange(40)}", f"v{rng.randrange(4000)}"]) for _ in range(rng.choice([0, 3, 49, 50, 51, 70, 200]))) for _ in range(60)]
    texts += [" ".join(f"u{i}" for i in range(60)), None, "", "  \n", "A" * 3000]
    docs = [(i, rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None])) for i in rng.sample(range(10_000), 300)]
    docs += docs[:20] + [(None, texts[0], "a"), (None, texts[-4], None)] + [(20_000 + i, texts[60], "hot") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in docs if i is not None and rng.random() < 0.5] + [(None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in audit.audit(odd_docs, labels).collect()) == brute(docs, [(1, 1, 0), (1, 0, 1), (99, 1, 1)])
    assert audit.audit(no_docs, labels).collect() == []
    assert len(audit.audit(odd_docs, labels.limit(0)).collect()) == 600 * len({s or "" for _, _, s in docs})


def test_transform_comes_back(spark):
    rng = random.Random(1)
    counts = {(p, m): rng.randrange(10**12) for p in "ab" for m in range(32)}
    rows = spark.createDataFrame([(p, False, False, m, n) for (p, m), n in counts.items()], "part string, good boolean, toxic boolean, mask int, n long")
    got = {r["part"]: r["cells"] for r in audit.inverted(audit.parity_sums(rows)).collect()}
    assert got == {p: [counts[p, m] for m in range(32)] for p in "ab"}
