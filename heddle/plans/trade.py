"""The driver's star tables as a typed graph, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.plans.registry import table

# label, table, key, name
LABELS = [("Customer", "customer", "c_custkey", "c_name"), ("Order", "orders", "o_orderkey", "o_orderpriority"), ("Part", "part", "p_partkey", "p_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Region", "region", "r_regionkey", "r_name")]
# relation, table, label and key of either end
RELATIONS = [
    ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey"),
    ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    ("SUPPLIED_BY", "lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey"),
    ("IN_NATION", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    ("IN_NATION", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
]


def node(label: str, key: str):
    return F.concat(F.lit(f"star.{label}."), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name, label, name, path, start_line, end_line."""
    legs = [
        table(spark, sf_dir, t).select(node(label, key).alias("qualified_name"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), F.concat(F.lit(f"{t}/"), (F.col(key) % 10).cast("string")).alias("path"), F.col(key).cast("long").alias("start_line"), (F.col(key) + 5).cast("long").alias("end_line"))
        for label, t, key, name in LABELS
    ]
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x)
    return out


def edges(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """rel, src, dst, each once.  ``by_key`` finds repeats among the keys, before these are names, which
    moves less where nothing later needs the rows by (rel, src, dst); no two relations share both a
    name and the labels of their ends."""
    keys = lambda df, *on: df.select(*on).distinct() if by_key else df
    legs = [keys(table(spark, sf_dir, t), ka, kb).select(F.lit(rel).alias("rel"), node(a, ka).alias("src"), node(b, kb).alias("dst")) for rel, t, a, ka, b, kb in RELATIONS]
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x)
    return out if by_key else out.distinct()


def keyed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name, kind, label, name: a node's key in place of its name, unique among those of its kind."""
    legs = [table(spark, sf_dir, t).select(F.col(key).cast("long").alias("qualified_name"), F.lit(i).alias("kind"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name")) for i, (label, t, key, name) in enumerate(LABELS)]
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x)
    return out


def keyed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, src, src_kind, dst, dst_kind, by the keys of ``keyed_nodes``; with repeats."""
    kinds = {label: i for i, (label, _, _, _) in enumerate(LABELS)}
    legs = [table(spark, sf_dir, t).select(F.lit(rel).alias("rel"), F.col(ka).cast("long").alias("src"), F.lit(kinds[a]).alias("src_kind"), F.col(kb).cast("long").alias("dst"), F.lit(kinds[b]).alias("dst_kind")) for rel, t, a, ka, b, kb in RELATIONS]
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x)
    return out


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of the same orders, in both directions: a cyclic graph."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    keys = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()  # keys are shorter than names
    pairs = keys.select(node("Customer", "o_custkey").alias("src"), node("Supplier", "l_suppkey").alias("dst"))
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


SQL_NODES = "nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT 'star.{label}.' || {key} AS qualified_name, '{label}' AS label, CAST({name} AS VARCHAR) AS name, '{t}/' || ({key} % 10) AS path, CAST({key} AS BIGINT) AS start_line, CAST({key} + 5 AS BIGINT) AS end_line FROM {t}" for label, t, key, name in LABELS) + ")"
SQL_EDGES = "edges AS MATERIALIZED (SELECT DISTINCT rel, src, dst FROM (" + " UNION ALL ".join(f"SELECT '{rel}' AS rel, 'star.{a}.' || {ka} AS src, 'star.{b}.' || {kb} AS dst FROM {t}" for rel, t, a, ka, b, kb in RELATIONS) + "))"
SQL_TRADES = "pairs AS (SELECT DISTINCT 'star.Customer.' || o_custkey AS src, 'star.Supplier.' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), trades AS MATERIALIZED (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs)"
