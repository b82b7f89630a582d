"""Cohort retention, average check and lifetime value.

Two cohort definitions: the month of the first donation, and the month of the first action. Rows are reduced to one
row per user and month before users meet their cohort, so every later step works on at most one row per user and
month, and everything after ``cohort_base`` on one row per cohort and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.functions.numbers import mean, money, money_mean, ratio
from donorlens.functions.periods import Spine
from donorlens.operators import pivots, ranking


def cohort_base(donations: DataFrame) -> DataFrame:
    """(cohort, month, n_customers, total_sales, n_customers_start) by month of first donation; months are DATEs.

    ``n_customers_start`` is the number of donors in the cohort's first month. Rows without id or time are left out.
    """
    user_months = (
        donations.where(F.col("customer_id").isNotNull() & F.col("order_ts").isNotNull())
        .groupBy("customer_id", periods.month("order_ts").alias("month"))
        .agg(F.sum("total_price").alias("sales"))
    )
    first_month = F.min("month").over(Window.partitionBy("customer_id"))
    per_month = (
        user_months.withColumn("cohort", first_month)
        .groupBy("cohort", "month")
        .agg(F.count("*").alias("n_customers"), F.sum("sales").alias("total_sales"))
    )
    start = F.max(F.when(F.col("month") == F.col("cohort"), F.col("n_customers")))
    return per_month.withColumn("n_customers_start", start.over(Window.partitionBy("cohort")))


def _over_spine(base: DataFrame, spine: Spine, drop_empty: bool) -> DataFrame:
    """``base`` clipped to the spine; unless ``drop_empty``, months without donations give one row without cohort."""
    if drop_empty:
        return base.where(spine.contains("month"))
    return spine.frame(base).join(base, "month", "left")


def retention_long(donations: DataFrame, spine: Spine) -> DataFrame:
    """(cohort, n_customers_start, month, n_customers, retention_rate)."""
    rate = F.round(ratio(F.col("n_customers") * 100, F.col("n_customers_start")), 1)
    rated = cohort_base(donations).where(spine.contains("month")).withColumn("retention_rate", rate)
    return rated.select(
        periods.month_label("cohort").alias("cohort"),
        "n_customers_start",
        periods.month_label("month").alias("month"),
        "n_customers",
        "retention_rate",
    )


def _matrix(cells: DataFrame, spine: Spine, value: str, *more: str) -> DataFrame:
    """``cells`` spread over one column per month. Cohorts stay dates until the end: relabelling them earlier would
    hide that the cells are already partitioned by cohort."""
    rows = ["cohort", "n_customers_start", *more]
    wide = pivots.matrix_pivot(
        cells.withColumn("month", periods.month_label("month")), rows, "month", spine.labels, value
    )
    return (
        wide.withColumn("cohort", periods.month_label("cohort"))
        .select(*rows[:2], *[F.col(f"`{m}`") for m in spine.labels], *more)
        .orderBy("cohort")
    )


def retention_matrix(donations: DataFrame, spine: Spine) -> DataFrame:
    rate = F.round(ratio(F.col("n_customers") * 100, F.col("n_customers_start")), 1)
    cells = cohort_base(donations).where(spine.contains("month")).withColumn("rate", rate)
    return _matrix(cells, spine, "rate")


CHECK = "decimal(28,2)"


def _monthly_check() -> Column:
    return F.coalesce(money_mean(F.col("total_sales"), F.col("n_customers")), F.lit(0.0))


def avg_check_matrix(donations: DataFrame, spine: Spine) -> DataFrame:
    """Revenue per donor by cohort and month; the last column is the mean of the cohort's months inside the spine."""
    checks = cohort_base(donations).where(spine.contains("month")).withColumn("check", _monthly_check())
    whole = Window.partitionBy("cohort")
    total, months = F.sum(F.col("check").cast(CHECK)).over(whole), F.count("check").over(whole)
    cells = checks.withColumn("average_cohort_check", money_mean(total, months))
    return _matrix(cells, spine, "check", "average_cohort_check")


def avg_check_by_cohort(donations: DataFrame, spine: Spine, drop_empty: bool = False) -> DataFrame:
    """Mean monthly check per cohort. Spine months without donations form a cohort-less row unless ``drop_empty``."""
    return (
        _over_spine(cohort_base(donations), spine, drop_empty)
        .withColumn("check", _monthly_check())
        .groupBy("cohort")
        .agg(money_mean(F.sum(F.col("check").cast(CHECK)), F.count("check")).alias("average_check"))
        .withColumn("cohort", periods.month_label("cohort"))
        .orderBy("cohort")
    )


def top_bottom_avg_check(donations: DataFrame, spine: Spine, k: int = 5, drop_empty: bool = False) -> DataFrame:
    checks = avg_check_by_cohort(donations, spine, drop_empty)
    return ranking.top_bottom_rank(checks, "average_check", "cohort", k, label="top_or_bottom").orderBy(
        F.desc("average_check"), "cohort"
    )


def _monthly_ltv(base: DataFrame, per_user: bool) -> DataFrame:
    """Monthly revenue per cohort as ``ltv``; divided by the cohort's size only if ``per_user``."""
    size = F.col("n_customers_start") if per_user else F.lit(1)
    revenue = F.coalesce(F.col("total_sales"), F.lit(0)).cast("decimal(30,2)")
    return base.withColumn("n_customers_start", size.cast("bigint")).withColumn(
        "ltv", F.round(F.try_divide(revenue, F.col("n_customers_start").cast("decimal(20,0)")), 2).cast("decimal(28,2)")
    )


def ltv_matrix(donations: DataFrame, spine: Spine, per_user: bool = False) -> DataFrame:
    """Running sum of monthly ``ltv`` by cohort and month; months without donations stay null."""
    monthly = _monthly_ltv(cohort_base(donations).where(spine.contains("month")), per_user)
    so_far = Window.partitionBy("cohort").orderBy("month")
    running = monthly.withColumn("ltv", money(F.sum("ltv").over(so_far)))
    return _matrix(running, spine, "ltv")


def ltv_running(donations: DataFrame, spine: Spine, drop_empty: bool = False) -> DataFrame:
    """Running total revenue per cohort and month with the cohort's size."""
    so_far = Window.partitionBy("cohort").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.coalesce(F.sum("total_sales").over(so_far), F.lit(0))
    running = _over_spine(cohort_base(donations), spine, drop_empty).withColumn("ltv", money(total))
    return running.select(
        periods.month_label("cohort").alias("cohort"),
        "n_customers_start",
        periods.month_label("month").alias("order_month"),
        "ltv",
    ).orderBy("cohort", "order_month")


def ltv_by_cohort(donations: DataFrame, per_user: bool = False) -> DataFrame:
    """Sum of monthly ``ltv`` per cohort over all months."""
    return (
        _monthly_ltv(cohort_base(donations), per_user)
        .groupBy("cohort")
        .agg(money(F.sum("ltv")).alias("ltv"))
        .withColumn("cohort", periods.month_label("cohort"))
        .orderBy("cohort")
    )


def top_bottom_ltv(donations: DataFrame, k: int = 5, per_user: bool = False) -> DataFrame:
    return ranking.top_bottom_rank(ltv_by_cohort(donations, per_user), "ltv", "cohort", k).orderBy(
        F.desc("ltv"), "cohort"
    )


def first_action_cohorts(actions: DataFrame) -> DataFrame:
    """(customer_id, cohort) with cohort the first day of the month of the user's first action."""
    return actions.groupBy("customer_id").agg(F.min("action_ts").alias("first_ts")).select(
        "customer_id", periods.month("first_ts").alias("cohort")
    )


def _retention_summary(donations: DataFrame, actions: DataFrame, include_inactive: bool) -> DataFrame:
    """Per action cohort: size, mean share of users that donated per month, number of months with donations.

    Users without donations make one more, empty, month with 0 % that enters the mean unless ``include_inactive`` is
    off.
    """
    cohorts = first_action_cohorts(actions)
    user_months = donations.select(
        F.col("customer_id").alias("donor_id"), periods.month("order_ts").alias("active_month")
    ).distinct()
    months = (
        cohorts.join(user_months, cohorts["customer_id"] == user_months["donor_id"], "left")
        .groupBy("cohort", "active_month")
        .agg(F.count("donor_id").alias("retained"))
    )
    if not include_inactive:
        months = months.where(F.col("active_month").isNotNull())
    sizes = cohorts.groupBy("cohort").agg(F.count("customer_id").alias("total_users"))
    rate = ratio(F.col("retained"), F.col("total_users")) * 100
    return (
        months.join(sizes, "cohort")
        .groupBy("cohort")
        .agg(
            F.max("total_users").alias("total_users"),
            F.round(F.avg(rate), 2).alias("average_retention_rate"),
            F.count("active_month").alias("active_months"),
        )
        .select(
            periods.month_label("cohort").alias("cohort_month"), "total_users", "average_retention_rate", "active_months"
        )
    )


def avg_retention_by_cohort(donations: DataFrame, actions: DataFrame, include_inactive: bool = True) -> DataFrame:
    return _retention_summary(donations, actions, include_inactive).drop("active_months").orderBy("cohort_month")


def top_bottom_retention(
    donations: DataFrame, actions: DataFrame, k: int = 5, min_months: int = 12, include_inactive: bool = True
) -> DataFrame:
    """Best and worst cohorts among those with donations in at least ``min_months`` months."""
    lasting = _retention_summary(donations, actions, include_inactive).where(F.col("active_months") >= min_months)
    return ranking.top_bottom_limit(
        lasting.drop("active_months"), "average_retention_rate", "cohort_month", k
    ).orderBy(F.desc("average_retention_rate"), "cohort_month", "category")


def avg_orders_by_cohort(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Mean number of donations of any status per user of an action cohort, users without donations included."""
    purchases = donations.groupBy("customer_id").agg(F.count("*").alias("n"))
    return (
        first_action_cohorts(actions)
        .join(purchases, "customer_id", "left")
        .groupBy("cohort")
        .agg(F.round(mean(F.coalesce(F.col("n"), F.lit(0))), 2).alias("average_purchases_per_user"))
        .select(periods.month_label("cohort").alias("cohort_month"), "average_purchases_per_user")
        .orderBy("cohort_month")
    )


def top_bottom_avg_orders(donations: DataFrame, actions: DataFrame, k: int = 5) -> DataFrame:
    averages = avg_orders_by_cohort(donations, actions)
    return ranking.top_bottom_limit(averages, "average_purchases_per_user", "cohort_month", k).orderBy(
        F.desc("category"), F.desc("average_purchases_per_user"), "cohort_month"
    )


def avg_orders_all_cohorts(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Unweighted mean of the rounded cohort means."""
    averages = avg_orders_by_cohort(donations, actions)
    return averages.agg(F.round(F.avg("average_purchases_per_user"), 2).alias("overall_average_purchases"))
