"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src customer, dst part, w quantity), one row an edge."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return graph.edges_of(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_partkey", "l_quantity")


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src supplier, dst part, w quantity)."""
    return graph.edges_of(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): suppliers and parts in one id space (parts from 1,000,000,000 on), for graphs of one node set."""
    return supplies(spark, sf_dir).select("src", (F.col("dst") + 1_000_000_000).alias("dst"), "w")


def cents(c: str) -> F.Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


def month(c: str) -> F.Column:
    return (F.year(c) * 12 + F.month(c)).cast("long")


def coupled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(acct, mid, tbin, amount) of suppliers and of customers, sharing parts and months; amounts in cents."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("amount"), month("l_shipdate").alias("tbin"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a = l.groupBy(F.col("l_suppkey").alias("acct"), F.col("l_partkey").alias("mid"), "tbin").agg(F.sum("amount").alias("amount"))
    c = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("acct"), F.col("l_partkey").alias("mid"), "tbin").agg(F.sum("amount").alias("amount"))
    return a, c


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, src, dst, w): suppliers to parts (0) and parts to customers (1)."""
    a, c = coupled(spark, sf_dir)
    first = a.groupBy(F.col("acct").alias("src"), F.col("mid").alias("dst")).agg(F.sum("amount").cast("double").alias("w"))
    second = c.groupBy(F.col("mid").alias("src"), F.col("acct").alias("dst")).agg(F.sum("amount").cast("double").alias("w"))
    return first.select(F.lit(0).alias("layer"), "*").unionByName(second.select(F.lit(1).alias("layer"), "*"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
