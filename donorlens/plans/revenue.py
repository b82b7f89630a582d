"""Revenue, revenue per user, average check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.functions.numbers import mean, money, money_mean, ratio
from donorlens.operators.ordered import Ordered
from donorlens.operators.pivots import with_total
from donorlens.schemas import PAID


def _paid(donations: DataFrame) -> DataFrame:
    return donations.where(F.col("status") == PAID)


def total_paid(donations: DataFrame) -> DataFrame:
    return _paid(donations).agg(money(F.sum("total_price")).alias("total_donate"))


def total_paid_by_year(donations: DataFrame) -> DataFrame:
    return (
        _paid(donations)
        .groupBy(periods.year("order_ts").alias("_year"))
        .agg(money(F.sum("total_price")).alias("total_donate"))
        .select(periods.year_label("_year").alias("financial_year"), "total_donate")
        .orderBy(F.desc("financial_year"))
    )


def running_revenue(donations: DataFrame, n: int | None = None) -> DataFrame:
    """Every paid donation in order of time (equal times by ``first_action_id``) with the number of paid donations and the
    revenue so far, over the whole table. No task sees more than one of ``n`` ranges of the order."""
    rows = Ordered(_paid(donations).select("first_action_id", "order_ts", "total_price"), "order_ts", "first_action_id", n=n)
    return rows.running(revenue="total_price").select(
        "first_action_id", "order_ts", F.col("row_number").alias("payments_so_far"), money(F.col("revenue")).alias("revenue_so_far")
    )


def donation_ranks(donations: DataFrame, n: int | None = None) -> DataFrame:
    """Every donation with its place and its rank by price, highest first, over the whole table; equal prices share a rank
    and are placed by ``first_action_id``."""
    rows = Ordered(donations.select("first_action_id", "total_price"), ("total_price", "desc"), "first_action_id", n=n)
    ranked = rows.ranked("total_price")
    return ranked.select("first_action_id", money(F.col("total_price")).alias("total_price"), "row_number", "rank")


def _per_acting_user(donations: DataFrame, actions: DataFrame, period, label: Column) -> DataFrame:
    """Paid revenue per distinct acting user; periods come from the actions."""
    users = actions.groupBy(period("action_ts").alias("_period")).agg(
        F.count_distinct("customer_id").alias("total_users")
    )
    income = _paid(donations).groupBy(period("order_ts").alias("_period")).agg(F.sum("total_price").alias("income"))
    total = F.coalesce(money(F.col("income")), F.lit(0.0))
    return users.join(income, "_period", "left").select(
        label, total.alias("total_income"), "total_users", ratio(total, F.col("total_users")).alias("arpu")
    )


def arpu_by_year(donations: DataFrame, actions: DataFrame) -> DataFrame:
    label = periods.year_label("_period").alias("year")
    return _per_acting_user(donations, actions, periods.year, label).orderBy("year")


def arpu_by_month(donations: DataFrame, actions: DataFrame) -> DataFrame:
    label = periods.month_label("_period").alias("year_month")
    return _per_acting_user(donations, actions, periods.month, label).orderBy("year_month")


def _per_paying_user(donations: DataFrame, period, label: Column) -> DataFrame:
    """Paid revenue per distinct paying user. The period without a date has users but no income assigned to it."""
    per_period = _paid(donations).groupBy(period("order_ts").alias("_period")).agg(
        F.sum("total_price").alias("income"), F.count_distinct("customer_id").alias("paying_users_count")
    )
    total = F.when(F.col("_period").isNull(), 0.0).otherwise(F.coalesce(money(F.col("income")), F.lit(0.0)))
    return per_period.select(
        label,
        total.alias("total_income"),
        "paying_users_count",
        ratio(total, F.col("paying_users_count")).alias("arppu"),
    )


def arppu_by_year(donations: DataFrame) -> DataFrame:
    label = periods.year_label("_period").alias("year")
    return _per_paying_user(donations, periods.year, label).orderBy("year")


def arppu_by_month(donations: DataFrame) -> DataFrame:
    label = periods.month_label("_period").alias("year_month")
    return _per_paying_user(donations, periods.month, label).orderBy("year_month")


def avg_check_by_year(donations: DataFrame) -> DataFrame:
    """Mean paid donation per year and over all rows (``Total``); the total is built from the yearly sums."""
    by_year = _paid(donations).groupBy(periods.year("order_ts").alias("_year")).agg(
        F.sum("total_price").alias("amount"), F.count("total_price").alias("n")
    )
    labelled = with_total(by_year, periods.year_label("_year"), "year", ["amount", "n"])
    return labelled.select("year", money_mean(F.col("amount"), F.col("n")).alias("average_check")).orderBy("year")


def avg_payments_and_lifetime(donations: DataFrame) -> DataFrame:
    per_user = _paid(donations).groupBy("customer_id").agg(
        F.min("order_ts").alias("first_ts"), F.max("order_ts").alias("last_ts"), F.count("*").alias("n_payments")
    )
    return per_user.agg(
        F.round(F.avg(periods.days_between("first_ts", "last_ts")), 2).alias("avg_days_between_first_last_pay"),
        F.round(mean("n_payments"), 2).alias("average_payments_per_user"),
    )


def avg_daily_check(donations: DataFrame) -> DataFrame:
    """Mean over days of the day's revenue per payment."""
    per_day = _paid(donations).groupBy(periods.day("order_ts").alias("_day")).agg(
        ratio(F.sum("total_price"), F.count("*")).alias("check")
    )
    return per_day.agg(F.round(F.avg("check"), 2).alias("overall_average_check"))
