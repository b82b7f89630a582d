"""Conversion from acting user to paying donor, and customer lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.functions.numbers import mean, ratio
from donorlens.schemas import PAID


def conversion_rate(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Paying donors per 100 acting users; the two groups need not overlap."""
    acting = actions.agg(F.count_distinct("customer_id").alias("unique_users"))
    paying = donations.where(F.col("status") == PAID).agg(F.count_distinct("customer_id").alias("paying_users_count"))
    rate = ratio(F.col("paying_users_count") * 100, F.col("unique_users"))
    return acting.crossJoin(F.broadcast(paying)).withColumn("conversion_rate", F.round(rate, 2))


def conversion_by_month(donations: DataFrame, actions: DataFrame) -> DataFrame:
    acting = actions.groupBy(periods.month("action_ts").alias("_month")).agg(
        F.count_distinct("customer_id").alias("unique_users")
    )
    paying = (
        donations.where(F.col("status") == PAID)
        .groupBy(periods.month("order_ts").alias("_month"))
        .agg(F.count_distinct("customer_id").alias("paying"))
    )
    paying_users = F.coalesce(F.col("paying"), F.lit(0).cast("bigint"))
    return (
        acting.join(paying, "_month", "left")
        .select(
            periods.month_label("_month").alias("month"),
            "unique_users",
            paying_users.alias("paying_users_count"),
            F.round(ratio(paying_users * 100, F.col("unique_users")), 2).alias("conversion_rate"),
        )
        .orderBy("month")
    )


def avg_conversion_below_100(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Mean of the rounded monthly rates that are below 100 %."""
    monthly = conversion_by_month(donations, actions).where(F.col("conversion_rate") < 100)
    return monthly.agg(F.round(F.avg("conversion_rate"), 2).alias("average_conversion_rate"))


def clv_by_year(donations: DataFrame) -> DataFrame:
    """Value of all user-years (mean donation x donations) per month of their lifetime within the year."""
    per_user = donations.groupBy("customer_id", periods.year("order_ts").alias("_year")).agg(
        (mean("total_price") * F.count("website_id")).alias("value"),
        (periods.days_between(F.min("order_ts"), F.max("order_ts")) / 30).alias("lifetime_months"),
    )
    return (
        per_user.groupBy("_year")
        .agg(F.round(F.try_divide(F.sum("value"), F.sum("lifetime_months")), 2).alias("average_clv"))
        .select(periods.year_label("_year").alias("order_year"), "average_clv")
        .orderBy("order_year")
    )
