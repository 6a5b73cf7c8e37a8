"""Queries of ``catalogue.SHARED`` whose keys have few values, run in a form whose tasks do not grow with the table.

Spark's own plan for their SQL gives one value of the key to one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.blocks import blocked_join
from ..operators.ranks import join_values, row_numbers


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    keys = ["c_nationkey", "c_mktsegment"]
    a = c.where("c_acctbal > 9000").selectExpr(*keys, "c_custkey AS a_key")
    b = c.selectExpr(*keys, "c_custkey AS b_key")
    return blocked_join(a, b, keys, "a_key < b_key").select("a_key", "b_key")


def win_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    orders = {"up": [relational.asc("p")], "down": [relational.desc("p")]}
    return row_numbers(o, ["o_orderstatus"], ["p"], "o_orderkey", orders).select("o_orderkey", "up", "down")


def win_expr_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir).select("c_custkey", (F.col("c_custkey") % 7).alias("k"), F.upper("c_mktsegment").alias("segment"))
    return row_numbers(c, ["k", "segment"], [], "c_custkey", {"rn": []}).select("c_custkey", "rn")


def _nations_of_segments(c: DataFrame):
    """Customers by segment and nation, and the window that goes through the nations of a segment."""
    counts = c.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return counts, Window.partitionBy("c_mktsegment").orderBy(relational.asc("c_nationkey"))


def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    counts, w = _nations_of_segments(c)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("c_mktsegment", "c_nationkey", (before + 1).cast("int").alias("r"), F.row_number().over(w).alias("d"))
    return join_values(c, ranks, ["c_mktsegment", "c_nationkey"]).select("c_custkey", "r", "d")


def win_range_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    counts, w = _nations_of_segments(c)
    upto = counts.withColumn("n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return join_values(c, upto, ["c_mktsegment", "c_nationkey"]).select("c_custkey", "n")


def win_partition_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.max("c_acctbal").alias("top"))
    return join_values(c, per, ["c_nationkey"]).select("c_custkey", "n", "mean", "top")


_QUERIES = (join_self, win_nulls, win_expr_partition, win_rank, win_range_peers, win_partition_agg)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
