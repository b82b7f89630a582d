"""Payment statuses and amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.functions import numbers, periods
from donorlens.operators import pivots, sets
from donorlens.schemas import FAILED, NOT_PAID, PAID


def payments_by_status(donations: DataFrame) -> DataFrame:
    return (
        donations.groupBy(F.col("status").alias("payment_status"))
        .agg(F.count("*").alias("count_payments"))
        .orderBy(F.desc("count_payments"), "payment_status")
    )


def payments_by_status_year(donations: DataFrame, years: list[int]) -> DataFrame:
    per_year = (
        donations.where(periods.in_years("order_ts", years))
        .groupBy(F.col("status").alias("payment_status"), periods.year("order_ts").alias("_year"))
        .agg(F.count("*").alias("n"))
    )
    return pivots.count_pivot(per_year, "payment_status", "_year", years, "n").orderBy("payment_status")


def users_by_status(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Distinct users present in both tables, per payment status."""
    return (
        donations.select("customer_id", F.col("status").alias("payment_status"))
        .distinct()
        .join(sets.keys(actions), "customer_id", "left_semi")
        .groupBy("payment_status")
        .agg(F.count("*").alias("unique_user_count"))
        .orderBy(F.desc("unique_user_count"), "payment_status")
    )


def users_by_status_count(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Users present in both tables by how many different statuses their payments have."""
    return (
        donations.groupBy("customer_id")
        .agg(F.count_distinct("status").alias("status_count"))
        .join(sets.keys(actions), "customer_id", "left_semi")
        .groupBy("status_count")
        .agg(F.count("*").alias("user_count"))
        .orderBy("status_count")
    )


def users_by_status_year(donations: DataFrame, actions: DataFrame, years: list[int]) -> DataFrame:
    per_year = (
        donations.where(periods.in_years("order_ts", years))
        .select("customer_id", F.col("status").alias("payment_status"), periods.year("order_ts").alias("_year"))
        .distinct()
        .join(sets.keys(actions), "customer_id", "left_semi")
        .groupBy("payment_status", "_year")
        .agg(F.count("*").alias("n"))
    )
    return pivots.count_pivot(per_year, "payment_status", "_year", years, "n").orderBy("payment_status")


def revenue_by_status_year(donations: DataFrame) -> DataFrame:
    def total(status: str):
        return numbers.money(F.sum(numbers.when_status(status, F.col("total_price"), F.lit(0))))

    return (
        donations.groupBy(periods.year("order_ts").alias("_year"))
        .agg(
            numbers.money(F.sum("total_price")).alias("total_amount"),
            total(PAID).alias("total_paid"),
            total(NOT_PAID).alias("total_not_paid"),
            total(FAILED).alias("total_failed"),
        )
        .withColumn("financial_year", periods.year_label("_year"))
        .select("financial_year", "total_amount", "total_paid", "total_not_paid", "total_failed")
        .orderBy("financial_year")
    )


def max_donations(donations: DataFrame) -> DataFrame:
    price = F.col("total_price")
    return donations.agg(
        numbers.money(F.max(price)).alias("max_order_amount"),
        numbers.money(F.max(numbers.when_status(PAID, price))).alias("max_paid_order_amount"),
        numbers.money(F.max(numbers.when_status(NOT_PAID, price))).alias("max_not_paid_order_amount"),
    )


def _count_in_range(donations: DataFrame, status: str, low: float, high: float) -> DataFrame:
    inside = (F.col("status") == status) & (F.col("total_price") > low) & (F.col("total_price") < high)
    return donations.where(inside).agg(F.count("*").alias("paid_orders_count"))


def paid_in_range(donations: DataFrame, low: int = 500, high: int = 200_000) -> DataFrame:
    return _count_in_range(donations, PAID, low, high)


def unpaid_in_range(donations: DataFrame, low: int = 500, high: int = 200_000) -> DataFrame:
    """Same as ``paid_in_range`` for unpaid rows, result column name included."""
    return _count_in_range(donations, NOT_PAID, low, high)
