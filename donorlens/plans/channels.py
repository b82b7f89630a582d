"""Acquisition channels (UTM source of the actions of donating users)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.functions import numbers, periods
from donorlens.operators import pivots, ranking, sets
from donorlens.schemas import PAID


def _sourced(actions: DataFrame, sentinels: Sequence[str]) -> DataFrame:
    """Actions with a known source. ``sentinels`` are the texts that stand for no source."""
    source = F.col("utm_source")
    return actions.where(source.isNotNull() & ~source.isin(list(sentinels))).select(
        "customer_id", periods.year("action_ts").alias("_year"), source.alias("source")
    )


def top_channels_by_year(
    donations: DataFrame, actions: DataFrame, years: list[int], k: int = 5, sentinels: Sequence[str] = ("none",)
) -> DataFrame:
    """Donating users per source and year, 0 where the source is outside that year's top k."""
    per_year = (
        _sourced(actions, sentinels)
        .distinct()
        .join(sets.keys(donations), "customer_id", "left_semi")
        .groupBy("_year", "source")
        .agg(F.count("*").alias("user_count"))
    )
    top = ranking.top_k_per_group(per_year, "_year", "user_count", "source", k)
    return pivots.count_pivot(top, "source", "_year", years, "user_count").orderBy("source")


def top_channel_orders(
    donations: DataFrame, actions: DataFrame, k: int = 5, sentinels: Sequence[str] = ("None",)
) -> DataFrame:
    """Each year's top k sources with paid donations and average check over the action x donation pairs of their users.

    The pairs are never built: per user they number n_actions * n_donations, so both sides are counted per user first
    and the counts are multiplied, as decimals of 38 digits. A number of orders beyond a BIGINT is an error.
    """
    acted = _sourced(actions, sentinels).groupBy("customer_id", "_year", "source").agg(F.count("*").alias("n_actions"))
    paid_price = numbers.when_status(PAID, F.col("total_price"))
    gave = donations.groupBy("customer_id").agg(
        F.count_if(F.col("status") == PAID).alias("n_paid"),
        F.count(paid_price).alias("n_priced"),
        F.coalesce(F.sum(paid_price), F.lit(0)).alias("sum_paid"),
    )
    weight = F.col("n_actions").cast("decimal(19,0)")
    pairs = lambda n: F.sum(weight * F.col(n).cast("decimal(18,0)"))
    # Cents as whole numbers, so that the product keeps all its digits.
    cents = (F.col("sum_paid") * 100).cast("decimal(19,0)")
    paid_sum = (F.sum(weight * cents) / F.lit(100)).cast("decimal(38,2)")
    per_source = (
        acted.join(gave, "customer_id")
        .groupBy("_year", "source")
        .agg(
            F.count("*").alias("user_count"),
            pairs("n_paid").cast("bigint").alias("total_paid_orders"),
            numbers.money_mean(paid_sum, pairs("n_priced")).alias("avg_check_per_user"),
        )
    )
    return (
        ranking.top_k_per_group(per_source, "_year", "user_count", "source", k)
        .withColumn("year", periods.year_label("_year"))
        .select("year", "source", "user_count", "total_paid_orders", "avg_check_per_user")
        .orderBy("year", F.desc("avg_check_per_user"), "source")
    )
