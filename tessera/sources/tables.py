"""Parquet tables and the derived inputs the operators are exercised on.

Every derived input is a lazy DataFrame over the full base tables; nothing
is sampled or capped. Null injection for the gap tables uses a
deterministic expression on the row key so both engines see the same
holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer account balance, order count and mean order total.

    Orders are pre-aggregated by customer (map-side partial aggregation)
    before the join, so the join moves one row per customer, not per order.
    """
    per_cust = (table(spark, sf_dir, "orders")
                .groupBy(F.col("o_custkey").alias("c_custkey"))
                .agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
                     F.avg("o_totalprice").alias("avg_total")))
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("acctbal"))
    return cust.join(per_cust, "c_custkey", "inner").select(
        "c_custkey", "acctbal", "n_orders", "avg_total")


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("value").alias("avg_value"),
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"))


def events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        # two kinds of gaps: NULL and NaN
        F.when(F.col("event_id") % 19 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def part_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit(float("nan")))
        .when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).alias("p_retailprice"),
        "p_type")


def part_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_gaps with outliers: every 97th price a thousand times as high."""
    return part_gaps(spark, sf_dir).withColumn(
        "p_retailprice", F.when(F.col("p_partkey") % 97 == 0, F.col("p_retailprice") * 1000).otherwise(F.col("p_retailprice")))


def line_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_num with outliers in price and quantity."""
    spike = (F.col("l_orderkey") + F.col("l_linenumber")) % 97 == 0
    return line_num(spark, sf_dir).withColumns({
        "l_extendedprice": F.when(spike, F.col("l_extendedprice") * 1000).otherwise(F.col("l_extendedprice")),
        "l_quantity": F.when((F.col("l_partkey") + F.col("l_suppkey")) % 89 == 0, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity"))})


def part_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_size", "p_retailprice",
        (F.col("p_size").cast("double") * F.col("p_retailprice")).alias("size_x_price"),
        F.lit(5.0).alias("const5"),
        "p_type")


def line_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def embed_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"),
                    F.col("label").alias("cluster"))
