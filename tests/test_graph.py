"""Graph operators against plain Python."""

import brute
import pytest
from arbora.operators import bfs as search
from arbora.operators import bridges as cut
from arbora.operators import euler, graph, stats
from arbora.operators.components import components, components_and_forest, spanning_forest, violations
from arbora.plans.shared import saved
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

SLOW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
EDGES = st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=24)


def arcs_of(spark, edges):
    return spark.createDataFrame([x for a, b in edges for x in ((a, b), (b, a))], "src long, dst long")


CASES = {
    "edge": [(0, 1)],
    "path": [(i, i + 1) for i in range(6)],
    "star": [(3, i) for i in range(7) if i != 3],
    "cycle": [(i, (i + 1) % 5) for i in range(5)],
    "two cycles and an edge": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)],
    "doubled edge": [(0, 1), (0, 1), (1, 2)],
    "self-loop": [(0, 0), (0, 1), (2, 2)],
    "two components": [(0, 1), (1, 2), (2, 0), (7, 8), (8, 9)],
}


def flags(df):
    return {(r.src, r.dst): r.is_bridge for r in df.collect()}


def expected(edges):
    found = brute.bridges(edges)
    return {x: frozenset(x) in found for a, b in edges for x in ((a, b), (b, a))}


@pytest.mark.parametrize("strategy", [*cut.STRATEGIES, "auto"])
def test_bridges_on_small_graphs(spark, strategy):
    """All cases as components of one graph."""
    edges = [(100 * k + a, 100 * k + b) for k, e in enumerate(CASES.values()) for a, b in e]
    assert flags(cut.bridges(arcs_of(spark, edges), strategy)) == expected(edges)


@pytest.mark.parametrize("strategy", ["ck", "hybrid"])
def test_marking_on_a_deep_tree(spark, strategy):
    """A path of 3000 nodes with chords, a few of which leave bridges between them, and hairs that are bridges."""
    chords = [(10, 900), (500, 1200), (1300, 1301), (1400, 2999)]
    edges = [(i, i + 1) for i in range(2999)] + chords + [(i, 5000 + i) for i in range(0, 3000, 100)]
    crossed = {i for a, b in chords if b - a > 1 for i in range(a, b)}
    want = {(i, i + 1): i not in crossed for i in range(2999)} | {x: False for x in chords if x[1] - x[0] > 1} | {(i, 5000 + i): True for i in range(0, 3000, 100)}
    want |= {(b, a): x for (a, b), x in want.items()}
    arcs = arcs_of(spark, edges)
    if strategy == "hybrid":
        assert flags(cut.bridges(arcs, strategy)) == want
    else:  # a search of a path takes 3000 levels, so its marking gets the tree
        nodes = euler.numbering(euler.euler_tour(arcs_of(spark, [(i, i + 1) for i in range(2999)] + [(i, 5000 + i) for i in range(0, 3000, 100)] + [(cut.TOP, 0)]).where("src < dst"), cut.TOP), cut.TOP)
        got = {(min(r.node, r.parent), max(r.node, r.parent)) for r in cut._unmarked(graph.symmetrise(arcs), saved(nodes)).collect()}
        assert got == {x for x, f in want.items() if f and x[0] < x[1]}


def test_large_components_are_no_tasks(spark, monkeypatch):
    """Components of more arcs than a task of the local strategy may hold are solved too, beside small ones."""
    monkeypatch.setattr(cut, "LOCAL_ARCS", 6)
    edges = CASES["two cycles and an edge"] + [(20, 21), (21, 22), (22, 20)] + [(30, 31)]
    assert flags(cut.bridges(arcs_of(spark, edges), "local")) == expected(edges)


def test_bridges_golden(spark):
    """The four-node example: offsets 0 2 5 7 8, columns 1 2 0 2 3 0 1 1."""
    rows = [(0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 1, 3), (5, 2, 0), (6, 2, 1), (7, 3, 1)]
    out = cut.bridges(spark.createDataFrame(rows, "arc_id long, src long, dst long"), connected=True)
    assert [r.is_bridge for r in out.orderBy("arc_id").collect()] == [False, False, False, False, True, False, False, True]
    assert cut.bridge_count(out).first()[0] == 2


def test_connected_is_checked(spark):
    with pytest.raises(cut.Disconnected):
        cut.bridges(arcs_of(spark, CASES["two components"]), connected=True)


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    for strategy in cut.STRATEGIES:
        assert cut.bridges(none, strategy).collect() == []
    assert components(none).collect() == [] and spanning_forest(none).collect() == []


@SLOW
@given(EDGES)
def test_bridges_at_random(spark, edges):
    for strategy in ("tv", "local"):
        assert flags(cut.bridges(arcs_of(spark, edges), strategy)) == expected(edges)


@SLOW
@given(EDGES)
def test_components_and_forest_at_random(spark, edges):
    want = brute.components(edges)
    arcs = arcs_of(spark, edges)
    found, forest = components_and_forest(arcs)
    assert {r.node: r.component for r in found.collect()} == want
    assert sorted((r.src, r.dst) for r in forest.collect()) == brute.minimum_forest(edges)
    assert violations(arcs, found, forest).collect() == []


def test_violations_are_found(spark):
    """Each fault planted alone in right labels and a right forest."""
    edges = [(0, 1), (1, 2), (2, 0), (5, 6), (6, 7)]
    arcs = arcs_of(spark, edges)
    labels, forest = {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 5}, [(0, 1), (0, 2), (5, 6), (6, 7)]

    def kinds(labels, forest):
        found = violations(arcs, spark.createDataFrame(labels, "node long, component long"), spark.createDataFrame(forest, "src long, dst long"))
        return {r.kind for r in found.collect()}

    own = list(labels.items())
    assert kinds(own, forest) == set()
    assert "arc" in kinds([*own[:-1], (7, 7)], forest)
    assert "missing" in kinds(own[1:], forest)
    assert "repeated" in kinds([*own, (7, 0)], forest)
    assert "name" in kinds([*own[:3], (5, 6), (6, 6), (7, 6)], forest)
    assert "edge" in kinds(own, [(0, 1), (0, 2), (5, 6), (5, 7)])
    assert "count" in kinds(own, [*forest, (1, 2)])
    assert "split" in kinds([(v, 0) for v, _ in own], [*forest[:2], (1, 2), *forest[2:]])


def test_hooks_along_a_path(spark):
    """All nodes hook to the one before, so one round's pointers run 700 hops; the forest is the minimum one."""
    edges = [(i, i + 1) for i in range(700)] + [(i, i + 2) for i in range(0, 690, 3)]
    found, forest = components_and_forest(arcs_of(spark, edges))
    assert {r.component for r in found.collect()} == {0}
    assert sorted((r.src, r.dst) for r in forest.collect()) == brute.minimum_forest(edges)


def test_csr_round_trip(spark):
    arcs = graph.numbered(graph.symmetrise(arcs_of(spark, [(0, 1), (1, 2), (1, 4)])))
    rows = graph.to_csr(arcs, 6).orderBy("src").collect()
    assert [(r.src, r.offset, r.degree) for r in rows] == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 5, 0), (4, 5, 1), (5, 6, 0)]
    back = graph.from_csr(graph.neighbour_lists(arcs)).orderBy("arc_id").collect()
    assert [(r.arc_id, r.src, r.dst) for r in back] == [(r.arc_id, r.src, r.dst) for r in arcs.orderBy("arc_id").collect()]


def test_hubs_are_several_rows(spark):
    arcs = graph.symmetrise(arcs_of(spark, [(0, i) for i in range(1, 100)]))
    rows = graph.neighbour_lists(arcs, block=16)
    assert max(r.degree for r in rows.collect()) <= 16 and rows.where("src = 0").count() == 7
    assert sorted(tuple(r) for r in graph.from_csr(rows).collect()) == sorted(tuple(r) for r in graph.numbered(arcs).collect())


def test_largest_component(spark):
    arcs, names = graph.largest_component(arcs_of(spark, [(5, 9), (9, 12), (2, 2), (1, 3)]))
    assert {(r.old, r.new) for r in names.collect()} == {(5, 0), (9, 1), (12, 2)}
    assert {(r.src, r.dst) for r in arcs.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_search(spark):
    edges = CASES["two cycles and an edge"] + [(30, 31)]
    for alpha in (0, 1000):
        trace = []
        found = search.bfs(arcs_of(spark, edges), 0, alpha=alpha, trace=trace)
        assert {r.node: r.distance for r in found.collect()} == brute.distances(edges, 0)
        assert {r.node: r.parent for r in found.collect()} == {0: None, 1: 0, 2: 0, 3: 2, 4: 3, 5: 3}
        assert set(trace) == {0: {"down"}, 1000: {"up"}}[alpha] or alpha == 0
    assert tuple(search.eccentricity(found).first()) == (3, 4)


def test_search_goes_down_and_up(spark):
    """A tail, a thick middle of two levels, and a tail behind it: down, then up, and the same nodes either way."""
    thick = [(100 + a, 200 + b) for a in range(14) for b in range(14)]
    edges = [(i, i + 1) for i in range(3)] + [(3, 100 + a) for a in range(14)] + thick + [(213, 300)] + [(300 + i, 301 + i) for i in range(2)]
    trace = []
    found = search.bfs(arcs_of(spark, edges), 0, alpha=4, trace=trace)
    assert {r.node: r.distance for r in found.collect()} == brute.distances(edges, 0)
    assert trace[0] == "down" and {"down", "up"} == set(trace)


def test_eccentricities(spark):
    edges = CASES["two cycles and an edge"] + [(20 + i, 21 + i) for i in range(5)]
    starts = sorted({v for e in edges for v in e}) + [90]
    want = {v: max(brute.distances(edges, v).values()) for v in starts[:-1]} | {90: 0}
    nodes = spark.createDataFrame([(v,) for v in starts + starts[:2]], "node long")
    assert sorted(map(tuple, search.eccentricities(arcs_of(spark, edges), nodes).collect())) == sorted(want.items())
    assert search.eccentricities(arcs_of(spark, edges), nodes.limit(0)).count() == 0
    assert search.eccentricities(arcs_of(spark, [(0, 0)]), nodes).agg({"ecc": "max"}).first()[0] == 0


def test_eccentricities_of_many_masks(spark, monkeypatch):
    """150 starts are three masks, the last bit of a BIGINT among them, two masks at a time."""
    monkeypatch.setattr(search, "MASKS", 2)
    edges = [(i, (i - 1) // 4) for i in range(1, 150)] + [(140, 90)]
    got = {r.node: r.ecc for r in search.eccentricities(arcs_of(spark, edges), spark.range(150).toDF("node")).collect()}
    assert got == {v: max(brute.distances(edges, v).values()) for v in range(150)}


def test_fringe_is_searched_by_its_guards(spark, monkeypatch):
    """40 hairs on a cycle of 8 are searched by way of 8 nodes, which bound them; two of one end are searched themselves."""
    asked = []

    def counted(arcs, starts, enough=None):
        asked.append(starts.distinct().count())
        return kept(arcs, starts, enough)

    kept = search.eccentricities
    monkeypatch.setattr(search, "eccentricities", counted)
    hairs = [(i % 8, 100 + i) for i in range(40)]
    edges = [(i, (i + 1) % 8) for i in range(8)] + hairs
    nodes = spark.createDataFrame([(b,) for _, b in hairs], "node long")
    assert search.widest(arcs_of(spark, edges), nodes, 6) == max(max(brute.distances(edges, b).values()) for _, b in hairs) == 6
    assert asked == [8, 0]
    asked.clear()
    assert search.widest(arcs_of(spark, edges), nodes, 0) == 6
    assert asked[0] == 8 and search.diameter_bounds(arcs_of(spark, edges)) == (6, 6)


def test_diameter_of_a_cycle(spark):
    """Nodes far from the centre have to be searched."""
    assert search.diameter_bounds(arcs_of(spark, [(i, (i + 1) % 9) for i in range(9)])) == (4, 4)


@pytest.mark.parametrize("name", ["path", "two cycles and an edge"])
def test_diameter_and_stats(spark, name):
    edges = CASES[name]
    nodes = {v for e in edges for v in e}
    want = max(max(brute.distances(edges, v).values()) for v in nodes)
    r = stats.graph_stats(arcs_of(spark, edges)).first()
    assert (r.n, r.m, r.bridges, r.diam_lb, r.diam_ub) == (len(nodes), 2 * len(edges), 2 * len(brute.bridges(edges)), want, want)


def test_queries_over_whole_tables(spark, tmp_path):
    """Lines of all quantities count; the queries of the same name without _whole read those of 45 or 48 on."""
    from arbora import queries

    lines = [(o, o * k % 7, (o + k) % 4, float(1 + (o * 5 + k) % 44)) for o in range(6) for k in range(1, 3)] + [(50, 60, 70, 3.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    own = queries.QUERIES
    part, supp = ({(2 * x[0], 2 * x[i] + 1) for x in lines} for i in (1, 2))
    top = brute.components(part)
    assert {tuple(r) for r in own["q_components_whole"](spark, str(tmp_path)).collect()} == set(top.items())
    assert own["q_components"](spark, str(tmp_path)).count() == 0
    far = brute.distances(supp, min(v for e in supp for v in e))
    assert {tuple(r) for r in own["q_bfs_levels_whole"](spark, str(tmp_path)).collect()} == set(far.items())
    flags = {(r.src, r.dst): r.is_bridge for r in own["q_bridges_tv_whole"](spark, str(tmp_path)).collect()}
    cut_edges = brute.bridges(supp)
    assert flags == {x: frozenset(x) in cut_edges for a, b in supp for x in ((a, b), (b, a))}
    big = max(set(top.values()), key=lambda c: (list(top.values()).count(c), -c))
    edges = [e for e in part if top[e[0]] == big]
    nodes = {v for e in edges for v in e}
    width = max(max(brute.distances(edges, v).values()) for v in nodes)
    got = own["q_graph_stats_whole"](spark, str(tmp_path)).first()
    assert (got.n, got.m, got.bridges) == (len(nodes), 2 * len(edges), 2 * len(brute.bridges(edges))) and got.diam_lb == width == got.diam_ub
