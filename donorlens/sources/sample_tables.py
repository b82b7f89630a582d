"""The sample star schema (customer, orders, lineitem, nation, events) read as actions and donations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.functions.periods import moment
from donorlens.schemas import FAILED, MONEY, NOT_PAID, PAID

YEARS = [1995, 1996, 1997, 1998]
SPINE_START, SPINE_MONTHS = "1995-01", 80
CAMPAIGN = (dt.datetime(1995, 12, 1), dt.datetime(1996, 2, 1))
NO_SOURCE = "NATION_0"
TOP_K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, placed = F.col("o_orderstatus"), F.col("o_orderdate")
    # Nested two-way choices on null-safe tests: the optimizer folds ``status = 'Paid'`` over them to a plain test of
    # the code, which the scan can push down.
    status = F.when(code.eqNullSafe("F"), PAID).otherwise(
        F.when(code.eqNullSafe("O"), NOT_PAID).otherwise(F.when(code.eqNullSafe("P"), FAILED))
    )
    begin, end = (moment(at) for at in CAMPAIGN)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("first_action_id"),
        F.col("o_orderkey").alias("website_id"),
        F.col("o_custkey").alias("customer_id"),
        placed.alias("order_ts"),
        F.col("o_totalprice").cast(MONEY).alias("total_price"),
        status.alias("status"),
        ((placed >= begin) & (placed < end)).alias("is_campaign"),
        (F.col("o_orderpriority") == "2-HIGH").alias("is_recurrent"),
    )


def actions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Shipments as user actions: customer_id, action_ts and, if asked for, channel_name and utm_source.

    Every order has a customer and every customer a nation, so tables that only supply unrequested columns are not
    joined. Orders meet their customer before they meet their lines: the join on order key then comes last, and
    whatever groups by customer afterwards combines on the map side instead of inheriting a customer partitioning.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    if extra:
        customers = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("channel_name"), "c_nationkey"
        )
        if "utm_source" in extra:
            nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("utm_source"))
            customers = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = orders.join(customers.select("customer_id", *extra), "customer_id")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("action_ts"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("customer_id", "action_ts", *extra)


def events_as_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("action_ts"))


def events_as_donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real times of day, for the activity metrics."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("order_ts"))
