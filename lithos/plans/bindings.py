"""Program facts bound onto the analytic tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Functions: one per line item, in the module of its supplier's nation."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = li.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.concat(F.lit("mod_"), F.col("s_nationkey").cast("string")).alias("module_id"), F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("class_id"), F.col("l_linenumber").alias("unit_no"),
        F.floor("l_quantity").cast("int").alias("complexity"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("loc"), F.col("l_linenumber").alias("params"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("max_depth"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("annotated"),
    )


UNITS = """units AS (SELECT 'mod_' || CAST(s_nationkey AS VARCHAR) AS module_id, l_partkey AS file_id, l_orderkey AS class_id, l_linenumber AS unit_no,
  CAST(floor(l_quantity) AS INTEGER) AS complexity, CAST(floor(l_extendedprice / 1000) AS INTEGER) AS loc, l_linenumber AS params,
  CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS max_depth, CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS annotated
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return u.groupBy("module_id", "class_id").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("methods"), F.sum("complexity").alias("wmc"), F.sum("annotated").alias("attributes"))


CLASSES = UNITS + """, classes AS (SELECT module_id, class_id, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS methods, CAST(sum(complexity) AS BIGINT) AS wmc, CAST(sum(annotated) AS BIGINT) AS attributes FROM units GROUP BY ALL)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Module edges: every line item, from its customer's nation to its supplier's."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    name = lambda c: F.concat(F.lit("mod_"), F.col(c).cast("string"))
    return rows.select(name("c_nationkey").alias("from_id"), name("s_nationkey").alias("to_id"), F.col("o_orderpriority").alias("kind"), F.lit(1).cast("long").alias("weight"))


EDGES = """edges AS (SELECT 'mod_' || CAST(c_nationkey AS VARCHAR) AS from_id, 'mod_' || CAST(s_nationkey AS VARCHAR) AS to_id, o_orderpriority AS kind, CAST(1 AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def pair_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"), F.min("kind").alias("kind"))


PAIRS = EDGES + """, pairs AS (SELECT from_id, to_id, CAST(sum(weight) AS BIGINT) AS weight, min(kind) AS kind FROM edges GROUP BY ALL)"""


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with ``n``, how many edges each stands for."""
    return edges(spark, d).groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n"))


def modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.concat(F.lit("mod_"), F.col("n_nationkey").cast("string")).alias("module_id"), F.col("n_name").alias("name"))


MODULES = "modules AS (SELECT 'mod_' || CAST(n_nationkey AS VARCHAR) AS module_id, n_name AS name FROM nation)"
