"""The graph and search tables that the registered queries run on, derived from the data directory's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import table

NODE_TYPES = ["Repository", "File", "Function", "Method", "Class", "Component", "Endpoint", "ApiCall", "Model", "Route", "Document"]
EDGE_TYPES = ["CONTAINS", "INHERITS", "FOREIGN_KEY", "MANY_TO_MANY", "ONE_TO_ONE", "CALLS", "IMPORTS", "MAKES_CALL", "CALLS_ENDPOINT", "HANDLES_REQUEST", "USES_MODEL", "RENDERS_AT"]
QUESTIONS = ["parser timeline queue", "очередь журнал парсер", "which endpoint loads the ledger table", "método lista registro", "Traceback KeyError catalog"]
GREP_TOKENS = ["parser", "timeline", "журнал", "ledger"]

SQL_NODES = """nodes AS (
  SELECT 'repo:region:' || r_regionkey AS id, 'Repository' AS type, r_name AS name FROM region
  UNION ALL SELECT 'repo:nation:' || n_nationkey, 'File', n_name FROM nation
  UNION ALL SELECT 'repo:customer:' || c_custkey, 'Class', c_name FROM customer
  UNION ALL SELECT 'repo:supplier:' || s_suppkey, 'Component', s_name FROM supplier
  UNION ALL SELECT 'repo:orders:' || o_orderkey, 'Function', 'order-' || o_orderkey FROM orders
  UNION ALL SELECT 'repo:part:' || p_partkey, 'Model', p_name FROM part)"""
SQL_EDGES = """edges AS (
  SELECT 'repo:region:' || n_regionkey AS src, 'repo:nation:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'repo:nation:' || c_nationkey, 'repo:customer:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'repo:nation:' || s_nationkey, 'repo:supplier:' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'repo:customer:' || o_custkey, 'repo:orders:' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT DISTINCT 'repo:orders:' || l_orderkey, 'repo:part:' || l_partkey, 'USES_MODEL' FROM lineitem)"""


def key(prefix: str, column: str):
    return F.concat(F.lit(f"repo:{prefix}:"), F.col(column).cast("string"))


def nodes(spark, d) -> DataFrame:
    parts = [
        ("region", "r_regionkey", "Repository", F.col("r_name")), ("nation", "n_nationkey", "File", F.col("n_name")), ("customer", "c_custkey", "Class", F.col("c_name")),
        ("supplier", "s_suppkey", "Component", F.col("s_name")), ("orders", "o_orderkey", "Function", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))), ("part", "p_partkey", "Model", F.col("p_name")),
    ]
    return reduce(DataFrame.unionByName, [table(spark, d, t).select(key(t, k).alias("id"), F.lit(ty).alias("type"), name.alias("name")) for t, k, ty, name in parts])


def edges(spark, d) -> DataFrame:
    parts = [("nation", "region", "n_regionkey", "nation", "n_nationkey", "CONTAINS"), ("customer", "nation", "c_nationkey", "customer", "c_custkey", "CONTAINS"), ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "CONTAINS"), ("orders", "customer", "o_custkey", "orders", "o_orderkey", "CALLS")]
    out = [table(spark, d, t).select(key(a, ak).alias("src"), key(b, bk).alias("dst"), F.lit(ty).alias("type")) for t, a, ak, b, bk, ty in parts]
    uses = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().select(key("orders", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("USES_MODEL").alias("type"))
    return reduce(DataFrame.unionByName, [*out, uses])


def of_type(rows: DataFrame, *types: str) -> DataFrame:
    return rows.where(F.col("type").isin(*types)).select("id")
