"""Graphs and trees derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.generate import KNUTH, grasp_tree
from arbora.operators.graph import both_ways, edges_of, symmetrise
from arbora.plans.scan import indexed
from arbora.plans.shared import derived, saved

#: Offsets that keep the node numbers of the geographic tree's levels apart.
REGION, NATION, CUSTOMER, SUPPLIER, ORDER = 1, 1_000, 1_000_000_000, 2_000_000_000, 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str, other: str = "part", least: float = 0.0) -> DataFrame:
    """Edges (src, dst), each as often as it is bought, from orders (even numbers) to parts or suppliers (odd numbers) of lines of at least that quantity."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least)
    return rows.select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col(f"l_{other}key") + 1).alias("dst"))


def purchase_arcs(spark: SparkSession, sf_dir: str, other: str = "part", least: float = 0.0) -> DataFrame:
    return symmetrise(purchases(spark, sf_dir, other, least))


def stored_arcs(spark: SparkSession, sf_dir: str, other: str = "part", least: float = 0.0) -> DataFrame:
    """purchase_arcs(), whose edges are stored once and turned as they are read."""
    return derived(both_ways(saved(edges_of(purchases(spark, sf_dir, other, least)), "edges")))


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, key): orders from 0 by their key, with their customer."""
    return indexed(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), ["o_orderkey"], "i").select(F.col("i").cast("long").alias("i"), "key")


def order_tree(spark: SparkSession, sf_dir: str, grasp: int) -> DataFrame:
    return saved(grasp_tree(numbered_orders(spark, sf_dir), grasp), "order-tree")


def order_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = saved(numbered_orders(spark, sf_dir), "orders")
    n = own.count()
    return own.select(F.col("i").alias("qid"), F.col("i").alias("x"), ((F.col("key") * 40503 + 7 * F.col("i")) % max(n, 1)).alias("y"))


def geographic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): world 0, regions, nations, customers and suppliers, orders."""
    parts = [
        spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent")),
        table(spark, sf_dir, "region").select((F.col("r_regionkey") + REGION).alias("node"), F.lit(0).alias("parent")),
        table(spark, sf_dir, "nation").select((F.col("n_nationkey") + NATION).alias("node"), (F.col("n_regionkey") + REGION).alias("parent")),
        table(spark, sf_dir, "customer").select((F.col("c_custkey") + CUSTOMER).alias("node"), (F.col("c_nationkey") + NATION).alias("parent")),
        table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("node"), (F.col("s_nationkey") + NATION).alias("parent")),
        table(spark, sf_dir, "orders").select((F.col("o_orderkey") + ORDER).alias("node"), (F.col("o_custkey") + CUSTOMER).alias("parent")),
    ]
    out = None
    for p in parts:
        p = p.select(F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))
        out = p if out is None else out.unionByName(p)
    return out


def geographic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, x, y): order k against customer (7 k) mod the number of customers."""
    n = table(spark, sf_dir, "customer").count()
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("qid"), (key + ORDER).alias("x"), ((7 * key) % max(n, 1) + CUSTOMER).alias("y"))


# --- the same in DuckDB SQL -------------------------------------------------------------------


def purchases_sql(other: str = "part", least: float = 0.0) -> str:
    return f"SELECT DISTINCT 2 * l_orderkey AS a, 2 * l_{other}key + 1 AS b FROM lineitem WHERE l_quantity >= {least}"


def order_tree_sql(grasp: int) -> str:
    width = "i" if grasp < 0 else f"least(i, {grasp})"
    return f"SELECT i AS node, CASE WHEN i > 0 THEN i - 1 - ((key * {KNUTH} + i) % {width}) END AS parent FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS key FROM orders)"


def order_queries_sql() -> str:
    return "SELECT i AS qid, i AS x, (key * 40503 + 7 * i) % n AS y FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS key, count(*) OVER () AS n FROM orders)"


def geographic_tree_sql() -> str:
    return (
        f"SELECT 0::BIGINT AS node, NULL::BIGINT AS parent UNION ALL SELECT r_regionkey + {REGION}, 0 FROM region UNION ALL SELECT n_nationkey + {NATION}, n_regionkey + {REGION} FROM nation "
        f"UNION ALL SELECT c_custkey + {CUSTOMER}::BIGINT, c_nationkey + {NATION} FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER}::BIGINT, s_nationkey + {NATION} FROM supplier UNION ALL SELECT o_orderkey + {ORDER}::BIGINT, o_custkey + {CUSTOMER}::BIGINT FROM orders"
    )


def geographic_queries_sql() -> str:
    return f"SELECT o_orderkey AS qid, o_orderkey + {ORDER}::BIGINT AS x, (7 * o_orderkey) % (SELECT count(*) FROM customer) + {CUSTOMER}::BIGINT AS y FROM orders"
