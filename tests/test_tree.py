"""Tree operators against plain Python."""

import random

import brute
import pytest
from arbora.operators import euler, generate, lca, stats
from arbora.operators.rmq import interval_minmax, levels
from arbora.plans import scan
from arbora.plans.pointer import list_rank, roots
from arbora.plans.scan import indexed, prefix_sum
from arbora.plans.shared import saved
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@st.composite
def trees(draw):
    """Parents by node, under a random renaming, so that the root isn't always 0."""
    n = draw(st.integers(1, 25))
    up = [None] + [draw(st.integers(0, i - 1)) for i in range(1, n)]
    names = draw(st.permutations(range(n)))
    return {names[i]: None if p is None else names[p] for i, p in enumerate(up)}


def tree_of(spark, parent):
    return spark.createDataFrame(list(parent.items()), "node long, parent long")


def pairs_of(spark, parent):
    nodes = sorted(parent)
    pairs = [(x, y) for x in nodes[:12] for y in nodes[-12:]]
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "qid long, x long, y long")


def answers(df):
    return {(r.x, r.y): r.lca for r in df.collect()}


def test_tour_golden(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 1), (4, 0)], "src long, dst long")
    got = {(r.src, r.dst): r.rank for r in euler.euler_tour(edges, 2).collect()}
    assert [got[x] for x in ((0, 1), (1, 2), (3, 1), (4, 0))] == [6, 7, 2, 5]
    assert [got[x] for x in ((1, 0), (2, 1), (1, 3), (0, 4))] == [3, 0, 1, 4]


def test_lca_golden(spark):
    tree = tree_of(spark, dict(enumerate([None, 0, 0, 1, 1, 3])))
    q = spark.createDataFrame([(0, 3, 5), (1, 0, 2), (2, 4, 5)], "qid long, x long, y long")
    nodes, heads = lca.index(tree)
    for out in (lca.by_inlabel(q, nodes, heads), lca.by_climbing(q, nodes), lca.by_range_minimum(q, tree), lca.batches(q, nodes, heads, 2)):
        assert [r.lca for r in out.orderBy("qid").collect()] == [3, 0, 1]


def test_climbing_takes_paths(spark, monkeypatch):
    """In a path of 400 nodes with hairs, climbing stores tables for log log n powers of two, not for each of log n; repeated ids keep their pairs."""
    parent = {i: i - 1 if i else None for i in range(400)} | {1000 + i: i for i in range(0, 400, 7)}
    nodes, names, store = lca.index(tree_of(spark, parent))[0], [], lca.saved
    monkeypatch.setattr(lca, "saved", lambda df, name: names.append(name) or store(df, name))
    pairs = [(x, y) for x in (0, 13, 399, 1007, 1399) for y in (0, 250, 399, 1000, 1007, 1392)]
    q = spark.createDataFrame([(i // 2, x, y) for i, (x, y) in enumerate(pairs)], "qid long, x long, y long")
    got = lca.by_climbing(q, nodes).collect()
    assert sorted((r.qid, r.x, r.y, r.lca) for r in got) == sorted((i // 2, x, y, brute.lca(parent, x, y)) for i, (x, y) in enumerate(pairs))
    assert names.count("climb") <= 6


def test_batches_are_few_jobs(spark, monkeypatch):
    """20 batches of one id each are dealt to JOBS jobs."""
    q, jobs = spark.range(20).select(F.col("id").alias("qid"), F.col("id").alias("x"), F.col("id").alias("y")), []
    monkeypatch.setattr(lca, "by_inlabel", lambda part, nodes, paths: part.withColumn("lca", F.col("x")))
    monkeypatch.setattr(lca, "saved", lambda df, name: jobs.append(name) or df)
    assert sorted(r.qid for r in lca.batches(q, None, None, 1).collect()) == list(range(20))
    assert len(jobs) == lca.JOBS


@SLOW
@given(trees())
def test_tour_and_numbers_at_random(spark, parent):
    root = next(v for v, p in parent.items() if p is None)
    edges = [(p, v) for v, p in parent.items() if p is not None]
    tree = tree_of(spark, parent)
    if edges:
        got = {(r.src, r.dst): r.rank for r in euler.euler_tour(euler.tree_edges(tree), root).collect()}
        assert got == brute.tour(edges, root)
    rows = {r.node: r for r in euler.numbered_tree(tree).collect()}
    assert {v: r.level for v, r in rows.items()} == {v: len(brute.ancestors(parent, v)) - 1 for v in parent}
    assert {v: r.size for v, r in rows.items()} == {v: sum(v in brute.ancestors(parent, w) for w in parent) for v in parent}
    assert sorted(r.pre for r in rows.values()) == list(range(1, len(parent) + 1))


@SLOW
@given(trees())
def test_lca_at_random(spark, parent):
    tree, q = tree_of(spark, parent), pairs_of(spark, parent)
    want = {(r.x, r.y): brute.lca(parent, r.x, r.y) for r in q.collect()}
    nodes, heads = lca.index(tree)
    assert answers(lca.by_inlabel(q, nodes, heads)) == want
    assert answers(lca.by_climbing(q, nodes)) == want
    assert answers(lca.by_range_minimum(q, tree)) == want


@SLOW
@given(trees())
def test_search_trees_at_random(spark, parent):
    """A search tree's levels give the tour that list ranking gives, with nodes that turn to smaller children last."""
    root = next(v for v, p in parent.items() if p is None)

    def depth(v):
        return 0 if parent[v] is None else 1 + depth(parent[v])

    found = saved(spark.createDataFrame([(v, depth(v), p) for v, p in parent.items()], "node long, distance long, parent long"))
    ranked = euler.visits(euler.tree_edges(tree_of(spark, parent)), root) if len(parent) > 1 else found.limit(0)
    assert sorted(map(tuple, euler.search_visits(found, root).select("parent", "node", "down", "up", "level").collect())) == sorted(map(tuple, ranked.select("parent", "node", "down", "up", "level").collect() if len(parent) > 1 else []))


def test_search_trees_rank_no_list(spark, monkeypatch):
    parent = {0: None, 5: 0, 3: 5, 9: 5, 7: 9, 2: 9, 8: 7}
    found = saved(spark.createDataFrame([(v, d, parent[v]) for v, d in ((0, 0), (5, 1), (3, 2), (9, 2), (7, 3), (2, 3), (8, 4))], "node long, distance long, parent long"))
    monkeypatch.setattr(euler, "sums_to_tail", None)
    assert {r.node: (r.down, r.up) for r in euler.search_visits(found, 0).collect()} == {5: (0, 11), 3: (1, 2), 9: (3, 10), 7: (4, 7), 8: (5, 6), 2: (8, 9)}
    with pytest.raises(TypeError):
        monkeypatch.setattr(euler, "FLAT", 3)
        euler.search_visits(found, 0)


def test_deep_path(spark):
    parent = {0: None} | {i: i - 1 for i in range(1, 300)}
    tree = tree_of(spark, parent)
    nodes, heads = lca.index(tree)
    q = spark.createDataFrame([(0, 299, 17), (1, 5, 5)], "qid long, x long, y long")
    assert answers(lca.by_inlabel(q, nodes, heads)) == {(299, 17): 17, (5, 5): 5}
    assert tuple(stats.height(nodes).first()) == (300, 150.5)


def test_root_is_checked(spark):
    with pytest.raises(ValueError):
        euler.root_of(tree_of(spark, {0: None, 1: None}))


def test_list_rank_and_roots(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (9, 1), (1, None)], "id long, next long")
    assert {r.id: r.rank for r in list_rank(links).collect()} == {5: 0, 3: 1, 9: 2, 1: 3}
    ring = spark.createDataFrame([(5, 3), (3, 9), (9, 5)], "id long, next long")
    assert {r.id: r.rank for r in list_rank(ring, head=9).collect()} == {9: 0, 5: 1, 3: 2}
    assert {r.node: (r.root, r.level) for r in roots(links.toDF("node", "parent")).collect()} == {5: (1, 3), 3: (1, 2), 9: (1, 1), 1: (1, 0)}


def test_splitters_write_less(spark, monkeypatch):
    """The same ranks with and without contraction; the rows that are written stay within a few times the list."""
    from arbora.plans import pointer

    n, rows = 4000, []
    ids = random.Random(2).sample(range(10**9), n)
    links = pointer.saved(spark.createDataFrame(list(zip(ids, [*ids[1:], None])), "id long, next long"))

    def counted(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    kept = pointer.saved
    monkeypatch.setattr(pointer, "saved", counted)
    want = dict(zip(ids, range(n)))
    assert {r.id: r.rank for r in list_rank(links).collect()} == want
    plain = sum(rows)
    rows.clear()
    assert {r.id: r.rank for r in list_rank(links, short=100).collect()} == want
    assert sum(rows) < 4 * n < plain


def test_scan(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k long, v long")
    assert [r.at for r in indexed(df, ["k"], "at").orderBy("k").collect()] == list(range(50))
    rows = prefix_sum(df, ["k"], "v", "s", exclusive=True).orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.s == total
        total += r.v


def test_row_numbers_run_no_python(spark, monkeypatch):
    monkeypatch.setattr(scan, "_summed", None)
    assert sorted(map(tuple, indexed(spark.range(0, 50, 5).repartition(3), ["id"], "i").collect())) == [(5 * i, i) for i in range(10)]


def test_interval_minmax(spark):
    values = spark.createDataFrame([(i, i * 5 % 11, i * 3 % 7) for i in range(11)], "pos long, lo long, hi long")
    asked = [(10 * a + b, a, b) for a in range(11) for b in range(a, 11)]
    df = spark.createDataFrame(asked, "key long, first long, last long")
    want = {k: (min(i * 5 % 11 for i in range(a, b + 1)), max(i * 3 % 7 for i in range(a, b + 1))) for k, a, b in asked}
    for width in (2, 3, 64):
        assert {r.key: (r.lo, r.hi) for r in interval_minmax(values, df, width).collect()} == want


def test_range_minima_take_linear_space(spark):
    values = spark.range(5000).select(F.col("id").alias("pos"), F.col("id").alias("lo"), F.col("id").alias("hi"))
    sizes = [x.select(F.sum(F.size("xs"))).first()[0] for x in levels(values, 16)]
    assert sizes == [5000, 313, 20, 2]


def test_generators(spark):
    for tree, grasp in ((generate.simple_tree(spark, 200, 10), 10), (generate.simple_tree(spark, 200), 200)):
        rows = {r.node: r.parent for r in tree.collect()}
        assert rows[0] is None and all(max(0, v - grasp) <= p < v for v, p in rows.items() if v)
    def numbered(n):
        return spark.range(n).select(F.col("id").alias("i"), F.expr("abs(hash(id)) % 1000").cast("long").alias("key"))

    free = {r.node: r.parent for r in generate.scale_free_tree(numbered(500)).collect()}
    assert len(free) == 500 and free[0] is None and all(p < v for v, p in free.items() if v)
    ends, want = [], {0: None}
    for i, key in sorted(tuple(r) for r in numbered(500).collect())[1:]:
        want[i] = ends[(key * generate.KNUTH + i - 1) % (2 * (i - 1))] if i > 1 else 0
        ends += [i, want[i]]
    assert free == want
    assert max(sum(p == v for p in free.values()) for v in free) > 15  # hubs
    new, names = generate.shuffled(tree)
    assert sorted(r.new for r in names.collect()) == list(range(200)) and new.where("parent is null").count() == 1
    assert generate.random_queries(spark, 10, 30).where((F.col("x") >= 10) | (F.col("y") < 0)).isEmpty()
    for n in (0, 1, 2):
        assert generate.scale_free_tree(numbered(n)).count() == n
