"""Registered queries of the graph and tree operators, over graphs derived from the tables, and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import bfs as search
from arbora.operators import bridges as cut
from arbora.operators import euler, generate, graph, lca, report, stats
from arbora.operators.components import components, components_and_forest, spanning_forest, violations
from arbora.plans import derive as d
from arbora.plans.pointer import list_rank
from arbora.plans.shared import folder, saved
from arbora.sources import store
from arbora.streaming import lca_probe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL pieces ------------------------------------------------------------------------------


def arcs_sql(other: str = "part", least: float = 0.0) -> str:
    return f"e AS ({d.purchases_sql(other, least)}), arcs AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e)"


CC = """cc(v, c) USING KEY (v) AS (SELECT DISTINCT u, u FROM arcs UNION
  SELECT r.v, min(cc.c) FROM cc JOIN arcs ON arcs.u = cc.v JOIN recurring.cc r ON r.v = arcs.v WHERE cc.c < r.c GROUP BY r.v)"""
BFS = """bfs(v, d) USING KEY (v) AS (SELECT min(u), 0::BIGINT FROM arcs UNION
  SELECT arcs.v, min(bfs.d) + 1 FROM bfs JOIN arcs ON arcs.u = bfs.v WHERE arcs.v NOT IN (SELECT v FROM recurring.bfs) GROUP BY arcs.v),
par AS (SELECT x.v AS v, min(y.v) AS p FROM bfs x JOIN arcs ON arcs.u = x.v JOIN bfs y ON y.v = arcs.v AND y.d = x.d - 1 GROUP BY x.v)"""
SEARCH_TREE = "t AS (SELECT bfs.v AS node, par.p AS parent FROM bfs LEFT JOIN par ON par.v = bfs.v)"
CLOSURE = "anc(v, a, h) AS (SELECT node, node, 0::BIGINT FROM t UNION ALL SELECT anc.v, t.parent, h + 1 FROM anc JOIN t ON t.node = anc.a WHERE t.parent IS NOT NULL)"
#: A node's children are visited from those above its own parent upwards, then those below; at the root plainly upwards.
NUMBERS = """lev AS (SELECT v AS node, max(h) AS level FROM anc GROUP BY v),
sz AS (SELECT a AS node, count(*) AS size FROM anc GROUP BY a),
sib AS (SELECT t.node, CASE WHEN t.parent IS NULL THEN 0 ELSE 1 + coalesce(sum(sz.size) OVER (PARTITION BY t.parent ORDER BY (CASE WHEN up.parent IS NULL OR t.node > up.parent THEN 0 ELSE 1 END), t.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS s
  FROM t JOIN sz USING (node) LEFT JOIN t up ON up.node = t.parent),
num AS (SELECT anc.v AS node, 1 + sum(sib.s) AS pre FROM anc JOIN sib ON sib.node = anc.a GROUP BY anc.v),
nodes AS (SELECT t.node AS node, t.parent AS parent, CAST(lev.level AS BIGINT) AS level, CAST(num.pre AS BIGINT) AS pre, CAST(sz.size AS BIGINT) AS size FROM t JOIN lev USING (node) JOIN sz USING (node) JOIN num USING (node))"""
MARKED = """nt AS (SELECT u, v FROM arcs WHERE u < v AND NOT EXISTS (SELECT 1 FROM par WHERE (par.v = arcs.u AND par.p = arcs.v) OR (par.v = arcs.v AND par.p = arcs.u))),
ends AS (SELECT nt.u, nt.v, anc.a FROM nt JOIN anc ON anc.v = nt.u UNION ALL SELECT nt.u, nt.v, anc.a FROM nt JOIN anc ON anc.v = nt.v),
marked AS (SELECT DISTINCT a FROM (SELECT u, v, a FROM ends GROUP BY u, v, a HAVING count(*) = 1)),
br AS (SELECT v, p FROM par WHERE v NOT IN (SELECT a FROM marked))"""


def search_sql(tail: str, other: str = "supp", least: float = 45) -> str:
    return f"WITH RECURSIVE {arcs_sql(other, least)}, {BFS}, {SEARCH_TREE}, {CLOSURE}, {NUMBERS}, {MARKED} {tail}"


def tree_sql(tree: str, tail: str) -> str:
    return f"WITH RECURSIVE t AS ({tree}), {CLOSURE}, {NUMBERS} {tail}"


def lca_sql(tree: str, queries: str) -> str:
    return f"WITH RECURSIVE t AS ({tree}), q AS ({queries}), {CLOSURE} SELECT qid, x, y, arg_min(a.a, a.h) AS lca FROM q JOIN anc a ON a.v = x JOIN anc b ON b.v = y AND b.a = a.a GROUP BY qid, x, y"


FLAGS = "SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS BIGINT) AS arc_id, u AS src, v AS dst, EXISTS (SELECT 1 FROM br WHERE (br.v = arcs.u AND br.p = arcs.v) OR (br.v = arcs.v AND br.p = arcs.u)) AS is_bridge FROM arcs"


# --- graphs ----------------------------------------------------------------------------------


@query("q_symmetrize", f"WITH {arcs_sql()} SELECT u AS src, v AS dst FROM arcs")
def q_symmetrize(spark: SparkSession, sf: str) -> DataFrame:
    return d.purchase_arcs(spark, sf)


@query("q_degree", f"WITH {arcs_sql()} SELECT u AS node, count(*) AS degree FROM arcs GROUP BY u")
def q_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(d.purchase_arcs(spark, sf))


def _dense(spark: SparkSession, sf: str, least: float = 48) -> tuple[DataFrame, int]:
    arcs, names = graph.largest_component(d.stored_arcs(spark, sf, "part", least), symmetric=True)
    return arcs, names.count()


DENSE = f"""WITH RECURSIVE {arcs_sql("part", 48)}, {CC},
best AS (SELECT c FROM cc GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
names AS (SELECT v AS old, row_number() OVER (ORDER BY v) - 1 AS new FROM cc WHERE c = (SELECT c FROM best)),
dense AS (SELECT s.new AS src, t.new AS dst FROM arcs JOIN names s ON s.old = u JOIN names t ON t.old = v)"""


@query("q_largest_component_relabel", DENSE + " SELECT src, dst FROM dense")
def q_largest_component_relabel(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    return _dense(spark, sf, least)[0]


@query("q_csr_offsets", DENSE + " SELECT new AS src, CAST(coalesce(sum(n) OVER (ORDER BY new ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", n AS degree FROM (SELECT new, (SELECT count(*) FROM dense WHERE src = new) AS n FROM names)")
def q_csr_offsets(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    return graph.to_csr(*_dense(spark, sf, least))


@query("q_csr_to_coo", DENSE + " SELECT row_number() OVER (ORDER BY src, dst) - 1 AS arc_id, src, dst FROM dense")
def q_csr_to_coo(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    return graph.from_csr(graph.neighbour_lists(_dense(spark, sf, least)[0]))


@query("q_components", f"WITH RECURSIVE {arcs_sql('part', 45)}, {CC} SELECT v AS node, c AS component FROM cc")
def q_components(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return components(d.purchase_arcs(spark, sf, "part", least))


@query("q_component_sizes", f"WITH RECURSIVE {arcs_sql('part', 48)}, {CC} SELECT c AS component, count(*) AS size FROM cc GROUP BY c")
def q_component_sizes(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    return graph.component_sizes(components(d.purchase_arcs(spark, sf, "part", least)))


@query("q_spanning_forest_size", f"WITH RECURSIVE {arcs_sql('part', 45)}, {CC} SELECT count(*) - count(DISTINCT c) AS edges FROM cc")
def q_spanning_forest_size(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return spanning_forest(d.purchase_arcs(spark, sf, "part", least)).agg(F.count("*").alias("edges"))


@query("q_spanning_forest")
def q_spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum forest's edges over all lines. SQL would take a recursion for each round of hooking, too slow for all lines."""
    return spanning_forest(d.purchase_arcs(spark, sf))


@query("q_component_violations", "SELECT CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS node WHERE false")
def q_component_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the components and the forest of all lines: nothing, so no rows."""
    arcs = d.stored_arcs(spark, sf)
    return violations(arcs, *components_and_forest(arcs, minimum=False))


@query("q_bfs_direction", f"WITH RECURSIVE {arcs_sql()}, {BFS} SELECT bfs.v AS node, d AS distance, p AS parent FROM bfs LEFT JOIN par ON par.v = bfs.v")
def q_bfs_direction(spark: SparkSession, sf: str) -> DataFrame:
    """A search over all lines that goes up on the levels with many arcs."""
    arcs = d.stored_arcs(spark, sf)
    return search.bfs(arcs, arcs.agg(F.min("src")).first()[0])


def _search(spark: SparkSession, sf: str, least: float = 45) -> tuple[DataFrame, DataFrame]:
    arcs = d.stored_arcs(spark, sf, "supp", least)
    return arcs, search.bfs(arcs, arcs.agg(F.min("src")).first()[0])


@query("q_bfs_levels", search_sql("SELECT v AS node, d AS distance FROM bfs"))
def q_bfs_levels(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return _search(spark, sf, least)[1].select("node", "distance")


@query("q_bfs_parent", search_sql("SELECT node, parent FROM t"))
def q_bfs_parent(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return _search(spark, sf, least)[1].select("node", "parent")


@query("q_bfs_unreached", f"WITH RECURSIVE {arcs_sql('part', 48)}, {BFS} SELECT DISTINCT u AS node, d AS distance FROM arcs LEFT JOIN bfs ON bfs.v = arcs.u")
def q_bfs_unreached(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    arcs = d.stored_arcs(spark, sf, "part", least)
    found = search.bfs(arcs, arcs.agg(F.min("src")).first()[0])
    return search.with_unreached(found, arcs.select(F.col("src").alias("node")).distinct()).select("node", "distance")


@query("q_spanning_tree_bfs", search_sql("SELECT p AS src, v AS dst FROM par"))
def q_spanning_tree_bfs(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return search.spanning_tree(_search(spark, sf, least)[1])


@query("q_eccentricity", search_sql("SELECT max(d) AS ecc FROM bfs"))
def q_eccentricity(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return search.eccentricity(_search(spark, sf, least)[1]).select("ecc")


@query("q_farthest", search_sql("SELECT min(v) AS farthest FROM bfs WHERE d = (SELECT max(d) FROM bfs)"))
def q_farthest(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return search.eccentricity(_search(spark, sf, least)[1]).select("farthest")


@query("q_max_distance", search_sql("SELECT max(d) AS max_distance FROM bfs"))
def q_max_distance(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return stats.max_distance(_search(spark, sf, least)[1])


DIAMETER = f"""WITH RECURSIVE {arcs_sql("part", 48)}, {CC}, best AS (SELECT c FROM cc GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
names AS (SELECT v AS old, row_number() OVER (ORDER BY v) - 1 AS new FROM cc WHERE c = (SELECT c FROM best)),
dense AS (SELECT s.new AS src, t.new AS dst FROM arcs JOIN names s ON s.old = u JOIN names t ON t.old = v),
far(k, d) USING KEY (k) AS (SELECT new * 1000000 + new, 0::BIGINT FROM names UNION
  SELECT (k // 1000000) * 1000000 + dst, min(d) + 1 FROM far JOIN dense ON src = k % 1000000
  WHERE (k // 1000000) * 1000000 + dst NOT IN (SELECT k FROM recurring.far) GROUP BY (k // 1000000) * 1000000 + dst)"""


@query("q_diameter_bounds", DIAMETER + " SELECT max(d) AS diam_lb, max(d) AS diam_ub FROM far")
def q_diameter_bounds(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    low, high = search.diameter_bounds(_dense(spark, sf, least)[0])
    return spark.range(1).select(F.lit(low).cast("long").alias("diam_lb"), F.lit(high).cast("long").alias("diam_ub"))


@query("q_graph_stats", DIAMETER + " SELECT (SELECT count(*) FROM names) AS n, (SELECT count(*) FROM dense) AS m, (SELECT 2 * (count(*) - 1) FROM names) AS bridges, max(d) AS diam_lb, max(d) AS diam_ub FROM far")
def q_graph_stats(spark: SparkSession, sf: str, least: float = 48) -> DataFrame:
    """The largest component of lines of 48 and more is a tree at all scales, so all of its arcs are bridges."""
    return stats.graph_stats(_dense(spark, sf, least)[0])


# --- tours and numberings --------------------------------------------------------------------


RANKED = 'SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS "rank", o_orderkey AS id FROM orders'


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Orders chained by customer, then key: each points to the next."""
    own = saved(d.indexed(d.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "i"), "chain")
    after = own.select((F.col("i") - 1).alias("i"), F.col("o_orderkey").alias("next"))
    return saved(own.join(after, "i", "left").select(F.col("o_orderkey").alias("id"), "next"), "chain")


@query("q_list_rank", RANKED)
def q_list_rank(spark: SparkSession, sf: str) -> DataFrame:
    return list_rank(_chain(spark, sf))


@query("q_list_rank_split", RANKED)
def q_list_rank_split(spark: SparkSession, sf: str) -> DataFrame:
    """By splitters, and splitters of splitters, until 1000 are left."""
    return list_rank(_chain(spark, sf), short=1000)


def _visits(spark: SparkSession, sf: str, least: float = 45) -> tuple[DataFrame, int, DataFrame]:
    arcs, found = _search(spark, sf, least)
    found = saved(found, "search")
    root = euler.root_of(found)
    return euler.search_visits(found, root), root, arcs


@query(
    "q_euler_tour",
    search_sql("SELECT parent AS src, node AS dst, 2 * pre - 3 - level AS \"rank\" FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT node, parent, 2 * pre - 3 - level + 2 * size - 1 FROM nodes WHERE parent IS NOT NULL"),
)
def q_euler_tour(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return euler.tour_of(_visits(spark, sf, least)[0])


@query("q_preorder_size_level", search_sql("SELECT node, parent, level, pre, size FROM nodes"))
def q_preorder_size_level(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return euler.numbers_of(*_visits(spark, sf, least)[:2]).drop("down")


def _from_zero(spark: SparkSession, sf: str, least: float = 45) -> tuple[DataFrame, DataFrame]:
    seen, root, arcs = _visits(spark, sf, least)
    return arcs, saved(euler.numbers_of(seen, root).withColumn("pre", F.col("pre") - 1), "numbers")


NEAR = "near AS (SELECT n.node, n.pre - 1 AS pre, n.size, coalesce(min(m.pre) - 1, (SELECT count(*) + 1 FROM nodes)) AS lo, coalesce(max(m.pre) - 1, -1) AS hi FROM nodes n LEFT JOIN arcs ON arcs.u = n.node AND (n.parent IS NULL OR arcs.v <> n.parent) LEFT JOIN nodes m ON m.node = arcs.v GROUP BY n.node, n.pre, n.size)"


@query("q_neighbour_minmax", search_sql(f", {NEAR} SELECT node, lo, hi FROM near"))
def q_neighbour_minmax(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return cut.neighbour_minmax(*_from_zero(spark, sf, least)).select("node", "lo", "hi")


@query("q_subtree_minmax", search_sql(f", {NEAR} SELECT anc.a AS node, min(lo) AS lo, max(hi) AS hi FROM anc JOIN near ON near.node = anc.v GROUP BY anc.a"))
def q_subtree_minmax(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
    return cut.subtree_minmax(*_from_zero(spark, sf, least)).select("node", "lo", "hi")


# --- bridges ---------------------------------------------------------------------------------


def _bridges(strategy: str) -> Query:
    def run(spark: SparkSession, sf: str, least: float = 45) -> DataFrame:
        arcs = graph.numbered(d.purchase_arcs(spark, sf, "supp", least))
        return cut.bridges(arcs, strategy).select("arc_id", "src", "dst", "is_bridge")

    return run


for _name in (*cut.STRATEGIES, "auto"):
    query(f"q_bridges_{_name}", search_sql(FLAGS))(_bridges(_name))


@query("q_bridge_count", search_sql("SELECT CAST(2 * count(*) AS BIGINT) AS bridges FROM br", "part", 0))
def q_bridge_count(spark: SparkSession, sf: str) -> DataFrame:
    return cut.bridge_count(cut.bridges(d.stored_arcs(spark, sf), "tv"))


# --- lowest common ancestors -----------------------------------------------------------------

MSB = "(length(bin({x})) - 1)"
INLABEL = f"lab AS (SELECT *, ((pre + size - 1) >> {MSB.format(x='xor(pre - 1, pre + size - 1)')}) << {MSB.format(x='xor(pre - 1, pre + size - 1)')} AS inlabel FROM nodes)"


@query("q_inlabel", tree_sql(d.order_tree_sql(-1), f", {INLABEL} SELECT node, inlabel FROM lab"))
def q_inlabel(spark: SparkSession, sf: str) -> DataFrame:
    return lca.inlabels(euler.numbered_tree(d.order_tree(spark, sf, -1))).select("node", "inlabel")


@query("q_ascendant", tree_sql(d.order_tree_sql(-1), f", {INLABEL} SELECT v AS node, CAST(sum(low) AS BIGINT) AS ascendant FROM (SELECT DISTINCT anc.v, l.inlabel & -l.inlabel AS low FROM anc JOIN lab l ON l.node = anc.a) GROUP BY v"))
def q_ascendant(spark: SparkSession, sf: str) -> DataFrame:
    return lca.index(d.order_tree(spark, sf, -1))[0].select("node", "ascendant")


@query("q_head", tree_sql(d.order_tree_sql(-1), f", {INLABEL} SELECT l.inlabel AS inlabel, l.node AS node FROM lab l LEFT JOIN lab u ON u.node = l.parent WHERE u.node IS NULL OR u.inlabel <> l.inlabel"))
def q_head(spark: SparkSession, sf: str) -> DataFrame:
    return lca.index(d.order_tree(spark, sf, -1))[1].select("inlabel", "node")


def _lca(method: str, tree: Callable[[SparkSession, str], DataFrame], asked: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own, q = saved(tree(spark, sf), "tree"), saved(asked(spark, sf), "pairs")
        if method == "rmq":
            return lca.by_range_minimum(q, own)
        if method == "climb":
            return lca.by_climbing(q, euler.numbered_tree(own))
        nodes, paths = lca.index(own)
        return lca.batches(q, nodes, paths, 4000 if method == "batched" else -1)

    return run


for _method in ("inlabel", "rmq", "climb"):
    query(f"q_lca_{_method}", lca_sql(d.order_tree_sql(1000), d.order_queries_sql()))(_lca(_method, lambda s, f: d.order_tree(s, f, 1000), d.order_queries))
    query(f"q_lca_{_method}_geo", lca_sql(d.geographic_tree_sql(), d.geographic_queries_sql()))(_lca(_method, d.geographic_tree, d.geographic_queries))
query("q_lca_batched", lca_sql(d.order_tree_sql(-1), d.order_queries_sql()))(_lca("batched", lambda s, f: d.order_tree(s, f, -1), d.order_queries))


@query("q_lca_stream", lca_sql(d.order_tree_sql(1000), d.order_queries_sql()))
def q_lca_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of q_lca_inlabel as a stream, a micro-batch for each file, against an index that is built once."""
    top = folder(spark, "lca-stream")
    d.order_queries(spark, sf).repartition(4, "qid").write.parquet(f"{top}/pairs")
    return lca_probe.drain(lca_probe.pairs(spark, f"{top}/pairs"), d.order_tree(spark, sf, 1000), f"{top}/answers", f"{top}/state")


# --- files -----------------------------------------------------------------------------------


@query("q_graph_file", f"""WITH {arcs_sql()}, names AS (SELECT u AS old, row_number() OVER (ORDER BY u) - 1 AS new FROM (SELECT DISTINCT u FROM arcs))
SELECT row_number() OVER (ORDER BY s.new, t.new) - 1 AS arc_id, s.new AS src, t.new AS dst FROM arcs JOIN names s ON s.old = u JOIN names t ON t.old = v""")
def q_graph_file(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of all lines, nodes numbered from 0, written as compressed rows and read back."""
    arcs = d.stored_arcs(spark, sf)
    names = saved(d.indexed(arcs.select(F.col("src").alias("old")).distinct(), ["old"], "new").select("old", F.col("new").cast("long").alias("new")), "names")
    own = arcs.join(names.toDF("src", "s"), "src").join(names.toDF("dst", "t"), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))
    path = folder(spark, "graph-file")
    store.write_graph(own, names.count(), path)
    return store.read_graph(spark, path).select("arc_id", "src", "dst")


@query("q_tree_file", f"SELECT t.node, t.parent, q.x, q.y FROM ({d.order_tree_sql(1000)}) t JOIN ({d.order_queries_sql()}) q ON q.qid = t.node")
def q_tree_file(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of orders with a pair for each, written as one test file and read back."""
    path = folder(spark, "tree-file")
    store.write_tree(d.order_tree(spark, sf, 1000), d.order_queries(spark, sf), path)
    tree, pairs = store.read_tree(spark, path)
    return tree.join(pairs, F.col("qid") == F.col("node")).select("node", "parent", "x", "y")


# --- statistics, generators, reports ---------------------------------------------------------


@query("q_tree_height", tree_sql(d.order_tree_sql(1000), "SELECT max(level) + 1 AS max_height, sum(level) / count(*) + 1 AS avg_height FROM nodes"))
def q_tree_height(spark: SparkSession, sf: str) -> DataFrame:
    return stats.height(euler.numbered_tree(d.order_tree(spark, sf, 1000)))


@query("q_depth_histogram", tree_sql(d.order_tree_sql(-1), "SELECT level, count(*) AS nodes FROM nodes GROUP BY level"))
def q_depth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.depth_histogram(euler.numbered_tree(d.order_tree(spark, sf, -1)))


@query("q_tree_generate_grasp", d.order_tree_sql(1000))
def q_tree_generate_grasp(spark: SparkSession, sf: str) -> DataFrame:
    return d.order_tree(spark, sf, 1000)


SCALE_FREE = f"""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS key FROM orders),
p AS (SELECT i - 1 AS e, CASE WHEN i > 1 THEN (key * {generate.KNUTH} + i - 1) % (2 * (i - 1)) END AS x FROM o WHERE i > 0),
c(e, k) AS (SELECT e, e FROM p UNION ALL SELECT c.e, p.x // 2 FROM c JOIN p ON p.e = c.k WHERE p.x % 2 = 1)
SELECT c.e + 1 AS node, CASE WHEN p.e = 0 THEN 0 ELSE p.x // 2 + 1 END AS parent FROM c JOIN p ON p.e = c.k WHERE p.e = 0 OR p.x % 2 = 0 UNION ALL SELECT 0, NULL WHERE EXISTS (SELECT 1 FROM o)"""


@query("q_tree_scale_free", SCALE_FREE)
def q_tree_scale_free(spark: SparkSession, sf: str) -> DataFrame:
    """A node for each order, whose customer picks the arc end that it copies."""
    return generate.scale_free_tree(saved(d.numbered_orders(spark, sf), "orders"))


@query("q_tree_generate_simple")
def q_tree_generate_simple(spark: SparkSession, sf: str) -> DataFrame:
    return generate.simple_tree(spark, d.table(spark, sf, "orders").count(), 1000)


NAMES = "names AS (SELECT o_orderkey, i AS old, row_number() OVER (ORDER BY c, i) - 1 AS new FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS c FROM orders))"


@query("q_shuffle_labels", f"WITH t AS ({d.order_tree_sql(-1)}), {NAMES} SELECT a.new AS node, b.new AS parent FROM t JOIN names a ON a.old = t.node LEFT JOIN names b ON b.old = t.parent")
def q_shuffle_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The permutation orders nodes by customer, then number."""
    names = d.indexed(d.numbered_orders(spark, sf), ["key", "i"], "new").select(F.col("i").alias("old"), F.col("new").cast("long").alias("new"))
    return generate.renamed(d.order_tree(spark, sf, -1), saved(names, "names"))


TIMINGS = "SELECT l_returnflag AS file, l_linestatus AS algo, CASE l_linenumber % 3 WHEN 0 THEN 'Overall' WHEN 1 THEN 'Preprocessing' ELSE 'Queries' END AS phase, l_quantity AS value FROM lineitem"


def _timings(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.when(F.col("l_linenumber") % 3 == 0, "Overall").when(F.col("l_linenumber") % 3 == 1, "Preprocessing").otherwise("Queries")
    return d.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("algo"), phase.alias("phase"), F.col("l_quantity").alias("value"))


@query("q_report_mean_std", f"WITH t AS ({TIMINGS}) SELECT file, algo, phase, round(avg(value), 6) AS mean, CASE WHEN phase = 'Overall' THEN round(stddev_pop(value), 6) END AS std FROM t GROUP BY file, algo, phase")
def q_report_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return report.combined(_timings(spark, sf), ["file", "algo"]).select("file", "algo", "phase", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q_report_throughput", f"WITH t AS ({TIMINGS}) SELECT file, algo, count(*) AS numQ, round(sum(value) FILTER (phase = 'Queries'), 6) AS ms, round(count(*) / (sum(value) FILTER (phase = 'Queries') / 1000), 6) AS queries_per_s FROM t WHERE regexp_matches(file, 'A|R') GROUP BY file, algo")
def q_report_throughput(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.restricted(_timings(spark, sf), {"file": "A|R"})
    counts = rows.groupBy("file", "algo").agg(F.count("*").alias("numQ"))
    both = report.throughput(report.wide(rows, ["file", "algo"], ["Overall", "Preprocessing", "Queries"]).join(counts, ["file", "algo"]), "numQ", "Queries", "queries_per_s")
    return both.select("file", "algo", "numQ", F.round("Queries", 6).alias("ms"), F.round("queries_per_s", 6).alias("queries_per_s"))


LOGGED = "SELECT o_orderkey AS k, o_custkey AS c FROM orders"


@query(
    "q_report_logs",
    f"WITH t AS ({LOGGED}) SELECT 'V' || k || '$V_' || k || '#Q_' || c || '#grasp_-1' AS file, k AS V, c AS Q, -1::BIGINT AS grasp, CAST(NULL AS BIGINT) AS batch, CAST(c % 7 AS BIGINT) AS found, algo, 'Overall' AS phase, CAST(k * 1.5 + a AS DOUBLE) AS ms FROM t, (VALUES ('inlabel', 0.25), ('naive', 0.5)) x(algo, a)",
)
def q_report_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs as a runner prints them, a case for each order (headers, timings, a count behind them, a blank line), read back."""
    own = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    name = F.concat(F.lit("V"), F.col("k"), F.lit("$V_"), F.col("k"), F.lit("#Q_"), F.col("c"), F.lit("#grasp_-1"))
    timings = [F.concat(F.lit(f"{a}: Overall: "), (F.col("k") * 1.5 + x).cast("string"), F.lit(" ms.")) for a, x in (("inlabel", 0.25), ("naive", 0.5))]
    printed = [F.concat(F.lit("%%% Lca: File: "), name), F.concat(F.lit("%%% N: "), F.col("k")), *timings, F.concat(F.lit("%%% # Found: "), F.col("c") % 7), F.lit("")]
    lines = own.select(F.concat(F.lit("log"), F.col("k") % 32).alias("run"), "k", F.posexplode(F.array(*printed)).alias("at", "line"))
    rows = report.parse_timings(lines.select("run", (F.col("k") * len(printed) + F.col("at")).alias("line_no"), "line"))
    rows = rows.select(F.col("headers")["File"].alias("file"), F.col("headers")["# Found"].cast("long").alias("found"), "algo", "phase", F.col("value").alias("ms"))
    return rows.select("*", *report.name_fields("file"))


# --- the same operators over whole tables ----------------------------------------------------

#: The SQL of these two goes from each node to all others, and counts on a tree.
NO_WHOLE_SQL = ("q_diameter_bounds", "q_graph_stats")

for _name, _f in list(QUERIES.items()):
    if "least" in signature(_f).parameters:
        _sql = None if _name in NO_WHOLE_SQL else re.sub(r"l_quantity >= 4[58]\b", "l_quantity >= 0.0", ORACLES[_name])
        query(f"{_name}_whole", _sql)(partial(_f, least=0.0))
