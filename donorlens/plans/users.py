"""User counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.operators import sets


def unique_action_users(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count_distinct("customer_id").alias("unique_users_customers"))


def unique_donors(donations: DataFrame) -> DataFrame:
    return donations.agg(F.count_distinct("customer_id").alias("unique_users_orders"))


def non_matched_ids(donations: DataFrame, actions: DataFrame, ignore_null_ids: bool = False) -> DataFrame:
    """Ids of actions without donations, then of donations without actions; one row per source row."""
    acting, donating = sets.key_counts(actions), sets.key_counts(donations)
    unmatched = sets.not_in(acting, donations, ignore_null_ids=ignore_null_ids).unionByName(
        sets.not_in(donating, actions, ignore_null_ids=ignore_null_ids)
    )
    return sets.repeat_rows(unmatched).withColumnRenamed("customer_id", "unique_user_id")


def create_non_matched_view(donations: DataFrame, actions: DataFrame, name: str = "v_non_matched_ids") -> None:
    """Register the unmatched ids as a view; fails if the view exists."""
    non_matched_ids(donations, actions).createTempView(name)


def non_matched_users_by_year(donations: DataFrame, actions: DataFrame) -> DataFrame:
    """Users seen in one table only. Users without donations have no order year, so theirs is null."""
    actions_only = (
        sets.key_counts(actions)
        .join(sets.keys(donations), "customer_id", "left_anti")
        .groupBy(F.lit(None).cast("string").alias("order_year"))
        .agg(F.count("customer_id").alias("unique_user_count"), F.lit("customers_only").alias("source"))
    )
    donations_only = (
        donations.select("customer_id", periods.year("order_ts").alias("_year"))
        .distinct()
        .join(sets.keys(actions), "customer_id", "left_anti")
        .groupBy("_year")
        .agg(F.count("customer_id").alias("unique_user_count"))
        .select(
            periods.year_label("_year").alias("order_year"), "unique_user_count", F.lit("orders_only").alias("source")
        )
    )
    return actions_only.unionByName(donations_only).orderBy("order_year", "source")
