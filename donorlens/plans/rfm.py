"""Recency, frequency, monetary segmentation.

Paid rows are first made distinct by (day, customer, price), which also spreads a customer with very many rows over
the cluster; the per-customer step then combines on the map side. The gaps between consecutive days add up to last
minus first, so the mean gap needs no sorted window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.functions.numbers import mean, money, money_mean
from donorlens.functions.segments import segment_description, segment_name
from donorlens.schemas import PAID

DAYS_PER_MONTH = 30.0


def rfm_base(donations: DataFrame) -> DataFrame:
    """(customer_id, recency_days, order_frequency_per_month, total_spent); donors of the very last day are left out."""
    paid = donations.where(F.col("status") == PAID)
    last_day = paid.agg(F.max(periods.day("order_ts")).alias("_last_day"))
    per_customer = (
        paid.where(F.col("customer_id").isNotNull())
        .select(periods.day("order_ts").alias("day"), "customer_id", "total_price")
        .distinct()
        .groupBy("customer_id")
        .agg(
            F.min("day").alias("first"),
            F.max("day").alias("last"),
            F.count("day").alias("n_dated"),
            F.sum("total_price").alias("total_spent"),
        )
    )
    mean_gap = F.try_divide(F.datediff("last", "first").cast("double"), F.col("n_dated") - 1)
    return (
        per_customer.crossJoin(F.broadcast(last_day))
        .withColumn("recency_days", F.datediff("_last_day", "last").cast("bigint"))
        .where(F.col("recency_days") != 0)
        .withColumn("order_frequency_per_month", F.when(mean_gap > 0, F.lit(DAYS_PER_MONTH) / mean_gap))
        .select("customer_id", "recency_days", "order_frequency_per_month", "total_spent")
    )


def _low_is_good(value: Column, average: Column, factors: tuple[int, int, int]) -> Column:
    near, mid, far = factors
    return (
        F.when(value <= average * near, 3).when(value <= average * mid, 2).when(value <= average * far, 1).otherwise(4)
    )


def _high_is_good(value: Column, average: Column, factors: tuple[int, int, int]) -> Column:
    low, mid, high = factors
    return (
        F.when(value >= average * high, 3).when(value >= average * mid, 2).when(value >= average * low, 1).otherwise(4)
    )


def rfm_score(base: DataFrame, factors: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """Score each customer against multiples of the population means (one broadcast row) and build the code."""
    means = base.agg(
        mean("recency_days").alias("_recency"),
        F.avg("order_frequency_per_month").alias("_frequency"),
        mean("total_spent").alias("_spent"),
    )
    return (
        base.crossJoin(F.broadcast(means))
        .withColumn("recency_score", _low_is_good(F.col("recency_days"), F.col("_recency"), factors).cast("bigint"))
        .withColumn(
            "frequency_score",
            _high_is_good(F.col("order_frequency_per_month"), F.col("_frequency"), factors).cast("bigint"),
        )
        .withColumn(
            "monetary_score", _high_is_good(money(F.col("total_spent")), F.col("_spent"), factors).cast("bigint")
        )
        .withColumn("RFM", F.concat(*[F.col(c).cast("string") for c in SCORES]))
        .drop("_recency", "_frequency", "_spent")
    )


SCORES = ("recency_score", "frequency_score", "monetary_score")


def rfm_customers(donations: DataFrame) -> DataFrame:
    """One row per customer with scores, code, the code's share of all customers and the segment texts."""
    scored = rfm_score(rfm_base(donations))
    per_code = scored.groupBy("RFM").agg(F.count("*").alias("_n"))
    total = per_code.agg(F.sum("_n").alias("_total"))
    share = F.round(F.col("_n") * 100.0 / F.col("_total"), 2)
    # At most 64 codes exist (three scores of four values), so the shares are always small enough to broadcast.
    shares = per_code.crossJoin(F.broadcast(total)).select(
        "RFM",
        share.cast("double").alias("percentage_RFM"),
        segment_name(F.col("RFM")).alias("segment_name"),
        segment_description(F.col("RFM")).alias("segment_description"),
    )
    return scored.join(F.broadcast(shares), "RFM").select(
        "customer_id",
        "recency_days",
        "order_frequency_per_month",
        money(F.col("total_spent")).alias("total_spent"),
        *SCORES,
        "RFM",
        "percentage_RFM",
        "segment_name",
        "segment_description",
    )


def rfm_segments(donations: DataFrame) -> DataFrame:
    """One row per code. ``avg_lifetime`` is the mean recency, ``avg_orders_count`` the mean monthly frequency."""
    return (
        rfm_score(rfm_base(donations))
        .groupBy(F.col("RFM").alias("rfm_segment"))
        .agg(
            F.count("*").alias("users_count_in_segment"),
            F.round(mean("recency_days"), 2).alias("avg_lifetime"),
            F.round(F.avg("order_frequency_per_month"), 2).alias("avg_orders_count"),
            money_mean(F.sum("total_spent"), F.count("total_spent")).alias("mean_donation_per_user"),
            money(F.sum("total_spent")).alias("total_donation_sum"),
        )
        .withColumn("segment_name", segment_name(F.col("rfm_segment")))
        .withColumn("segment_description", segment_description(F.col("rfm_segment")))
        .orderBy(F.desc("avg_orders_count"), "rfm_segment")
    )
