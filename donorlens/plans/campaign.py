"""Campaign participation. One pass over donations gives a row per donor; the metrics filter and count those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.functions import numbers, periods
from donorlens.schemas import PAID


def _donors(donations: DataFrame) -> DataFrame:
    in_campaign = F.col("is_campaign")
    return (
        donations.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.min("order_ts").alias("first_ts"),
            F.max("order_ts").alias("last_ts"),
            F.min(F.when(in_campaign, F.col("order_ts"))).alias("campaign_first_ts"),
            F.count_if(in_campaign).alias("campaign_rows"),
            F.sum("total_price").alias("planned"),
            F.sum(numbers.when_status(PAID, F.col("total_price"), F.lit(0))).alias("paid"),
        )
        .where(F.col("campaign_rows") > 0)
    )


def campaign_window(donations: DataFrame) -> DataFrame:
    return donations.where("is_campaign").agg(
        F.min("order_ts").alias("newyear_start"), F.max("order_ts").alias("newyear_end")
    )


def campaign_users(donations: DataFrame) -> DataFrame:
    return donations.where("is_campaign").agg(F.count_distinct("customer_id").alias("user_count_newyear"))


def campaign_participation_pct(donations: DataFrame) -> DataFrame:
    per_user = donations.groupBy("customer_id").agg(F.count_if("is_campaign").alias("campaign_rows"))
    took_part = F.count(F.when(F.col("campaign_rows") > 0, F.col("customer_id")))
    share = numbers.ratio(took_part, F.count("customer_id")) * 100
    return per_user.agg(F.round(share, 2).alias("percent_participated_newyear"))


def campaign_users_by_first_action_year(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Campaign donors by the year of their first action, with all they planned to give and what they paid."""
    first_action = actions.groupBy("customer_id").agg(F.min("action_ts").alias("first_action_ts"))
    planned, paid = F.sum("planned"), F.sum("paid")
    return (
        _donors(donations)
        .join(first_action, "customer_id")
        .groupBy(periods.year("first_action_ts").alias("_year"))
        .agg(
            F.count("*").alias("user_count"),
            numbers.money(planned).alias("total_planned_donations"),
            numbers.money(paid).alias("paid_donations"),
            F.when(planned > 0, F.round(numbers.ratio(paid * 100, planned), 2))
            .otherwise(0.0)
            .alias("total_donations_percentage"),
        )
        .withColumn("active_year", periods.year_label("_year"))
        .select(
            "active_year", "user_count", "total_planned_donations", "paid_donations", "total_donations_percentage"
        )
        .orderBy("active_year")
    )


def campaign_returned_users(donations: DataFrame) -> DataFrame:
    """Campaign donors with any donation later than their first one in the campaign."""
    returned = _donors(donations).where(F.col("last_ts") > F.col("campaign_first_ts"))
    return returned.agg(F.count("*").alias("post_newyear_user_count"))


def _first_time_donors(donations: DataFrame) -> DataFrame:
    """Campaign donors whose very first donation lies inside the campaign window."""
    window = F.broadcast(campaign_window(donations))
    return _donors(donations).crossJoin(window).where(F.col("first_ts").between(F.col("newyear_start"), F.col("newyear_end")))


def campaign_first_time_donors(donations: DataFrame, distinct: bool = False) -> DataFrame:
    """Campaign rows of first-time donors; ``distinct`` counts the donors instead."""
    counted = F.count("*") if distinct else F.coalesce(F.sum("campaign_rows"), F.lit(0))
    return _first_time_donors(donations).agg(counted.cast("bigint").alias("newyear_user_count"))


def campaign_first_time_returned(donations: DataFrame) -> DataFrame:
    """First-time campaign donors who gave again after the campaign ended."""
    returned = _first_time_donors(donations).where(F.col("last_ts") > F.col("newyear_end"))
    return returned.agg(F.count("*").alias("users_with_repeat_payment"))
