"""Networks made from the star-schema tables, and the same networks as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from the customer's nation to the supplier's; weight: line items."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return e.groupBy(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


NATION_TRADE = "trade AS (SELECT CAST(c_nationkey AS VARCHAR) src, CAST(s_nationkey AS VARCHAR) dst, CAST(count(*) AS DOUBLE) weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col(n.columns[0]).cast("string").alias("id"), F.col([c for c in n.columns if c.endswith("regionkey")][0]).cast("int").alias("community"))


NATIONS = "nodes AS (SELECT CAST(n_nationkey AS VARCHAR) id, CAST(n_regionkey AS INTEGER) community FROM nation)"


def busy_trade(spark: SparkSession, sf_dir: str, share: float = 1.2) -> DataFrame:
    """Trade arcs without loops of more than ``share`` times the mean weight: a sparse directed graph."""
    t = nation_trade(spark, sf_dir)
    return t.crossJoin(F.broadcast(t.agg(F.avg("weight").alias("_m")))).filter(f"src <> dst and weight > {share} * _m").drop("_m")  # one row


def busy_sql(share: float = 1.2) -> str:
    return f"{NATION_TRADE}, busy AS (SELECT * FROM trade WHERE src <> dst AND weight > {share} * (SELECT avg(weight) FROM trade))"


def part_pairs(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Pairs of parts in one order, smaller key first; weight: orders; at least ``least`` of them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = li.select("l_orderkey", F.col("l_partkey").alias("p2"))
    pairs = li.join(other, "l_orderkey").filter("l_partkey < p2").groupBy("l_partkey", "p2").agg(F.count("*").cast("double").alias("weight"))
    return pairs.filter(F.col("weight") >= least).select(F.col("l_partkey").cast("string").alias("src"), F.col("p2").cast("string").alias("dst"), "weight")


PART_PAIRS = "lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), pairs AS (SELECT CAST(a.l_partkey AS VARCHAR) src, CAST(b.l_partkey AS VARCHAR) dst, CAST(count(*) AS DOUBLE) weight FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2)"


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite: customers' nations and suppliers, weight: line items."""
    li, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return e.groupBy(F.col("c_nationkey").cast("string").alias("left"), F.col("l_suppkey").cast("string").alias("right")).agg(F.count("*").cast("double").alias("weight"))


CUSTOMER_SUPPLIER = "links AS (SELECT CAST(c_nationkey AS VARCHAR) l, CAST(l_suppkey AS VARCHAR) r, CAST(count(*) AS DOUBLE) weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
