import numpy as np
import pytest
from arbora.llm import postings
from arbora.llm.postings import PostingParams

SMALL = PostingParams(k=4, list_rows=16, bin_values=64 * 6, query_rows=7)


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>{more}")


def brute(rows, k, asked):
    """For each asked row (id, vector): its k best (id, score), own ids left out."""
    out = {}
    for i, v in rows:
        if asked(i):
            best = {}
            for j, w in rows:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float((np.array(v) * np.array(w)).sum()))
            out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def overlap(a, b):
    return sum(len({i for i, _ in a.get(q, [])} & {i for i, _ in x}) for q, x in b.items()) / sum(len(x) for x in b.values())


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(12, size=400)] + 0.3 * rng.normal(size=(400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(postings.neighbours(table(spark, rows), "vec_id % 5 = 0", SMALL)), brute(rows, 4, lambda i: i % 5 == 0)
    assert got.keys() == want.keys() and overlap(got, want) >= 0.9
    assert all(len(v) == 4 for v in got.values())
    assert all(s == pytest.approx(float((x[q] * x[j]).sum()), abs=1e-12) for q, v in got.items() for j, s in v)
    again = found(postings.neighbours(table(spark, rows[::-1]), "vec_id % 5 = 0", SMALL))
    assert overlap(again, got) == 1


def test_norms_that_differ_widely(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * np.exp(rng.normal(size=(300, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert overlap(found(postings.neighbours(table(spark, rows), "vec_id % 10 = 0", SMALL)), brute(rows, 4, lambda i: i % 10 == 0)) >= 0.9


def test_copies_and_ties(spark):
    """A third of the rows is one vector, many of them queries; ties go to smaller ids."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(200)] + [(199, [9.0, 9.0, 9.0])] * 2
    rows += [(500, [4.0, 0.0, 0.0]), (501, [0.0, 4.0, 0.0])]
    got, want = found(postings.neighbours(table(spark, rows), "vec_id % 3 = 0", SMALL)), brute(rows, 4, lambda i: i % 3 == 0)
    assert got.keys() == want.keys()
    same = [q for q in want if q % 3 == 0]
    assert overlap({q: got[q] for q in same}, {q: want[q] for q in same}) >= 0.9
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and [i for i, _ in got[96]] == [i for i, _ in want[96]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (20, [1.0, 1.0])]
    rows = [(*r, 1, "x", 2) for r in rows]
    got = found(postings.neighbours(table(spark, rows, ", rank int, entry string, list int"), "vec_id > 6 or vec_id = 0"))
    assert got == {7: [(20, 1.0), (8, 0.5)], 8: [(20, 1.0), (7, 0.5)], 20: [(7, 1.0), (8, 1.0)]}
    assert found(postings.neighbours(table(spark, [(1, [1.0])]), "vec_id = 1")) == {}
    empty = postings.neighbours(table(spark, []), "vec_id = 1")
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_walk_finds_what_all_distances_find():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    norm = float(np.linalg.norm(x, axis=1).max())
    lists = postings.fit(x, 100, norm, PostingParams())
    q = postings.asking(x[:200], norm)
    d = postings.distances(q, lists.centroids)
    within = d <= d.min(1, keepdims=True) * (1 + lists.ratio)
    got = postings.walk(q, lists, lists.ratio) < np.inf
    assert (got & within).sum() >= 0.99 * within.sum() and not (got & ~(d <= d.min(1, keepdims=True) * (1.000001 + lists.ratio))).any()


def test_lists_are_balanced_and_boundaries_are_in_several():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4096, 8))
    norm = float(np.linalg.norm(x, axis=1).max())
    p = PostingParams(spread=0.1)
    c = postings.balanced_centroids(postings.lifted(x, norm), 32, 1)
    held = postings.assigned(postings.lifted(x, norm), c, p)
    first = np.bincount(postings.distances(postings.lifted(x, norm), c).argmin(1), minlength=32)
    assert held.any(1).all() and held.sum(1).max() <= p.replicas and 1 < held.sum(1).mean() < p.replicas
    assert first.max() < 8 * first.mean()


def test_packed():
    assert postings.packed([3, 3, 3, 25, 1, 9, 2], 10) == [(0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (4, 1), (5, 1)]
