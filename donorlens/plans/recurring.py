"""Recurrent donors and repeat payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.operators.ordered import Ordered
from donorlens.operators import pivots, sets, skew
from donorlens.operators.ordered import Ordered
from donorlens.schemas import PAID


def _paid() -> Column:
    return F.col("status") == PAID


def _paid_once() -> Column:
    """A paid donation that is not part of a recurrent plan."""
    return _paid() & ~F.col("is_recurrent")


def recurrent_users(donations: DataFrame) -> DataFrame:
    return donations.where("is_recurrent").agg(F.count_distinct("customer_id").alias("recurrents_count"))


def recurrent_users_by_first_year(donations: DataFrame) -> DataFrame:
    return (
        donations.where("is_recurrent")
        .groupBy("customer_id")
        .agg(F.min("order_ts").alias("first_ts"))
        .groupBy(periods.year("first_ts").alias("_year"))
        .agg(F.count("*").alias("recurrent_users_count"))
        .select(periods.year_label("_year").alias("first_payment_year"), "recurrent_users_count")
        .orderBy("first_payment_year")
    )


def repeat_payers_non_recurrent(donations: DataFrame) -> DataFrame:
    """Users with a paid non-recurrent donation and more than one first-action id over all their rows.

    More than one distinct id means the smallest differs from the largest, so no distinct set is built per user.
    """
    per_user = (
        donations.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count_if(_paid_once()).alias("paid_once"),
            F.min("first_action_id").alias("low_id"),
            F.max("first_action_id").alias("high_id"),
        )
    )
    repeat = per_user.where((F.col("paid_once") > 0) & (F.col("low_id") != F.col("high_id")))
    return repeat.agg(F.count("*").alias("users_with_repeat_payment"))


def payment_gaps(donations: DataFrame, n: int | None = None) -> DataFrame:
    """Every paid donation of a known user with the days since the user's one before it and until the next.

    Equal times come by ``first_action_id``. Unlike the sums of gaps above this needs the rows in order: they are dealt by
    ranges of user and time, ``n`` of them, so that a user with a third of all payments spans many tasks.
    """
    paid = donations.where(_paid() & F.col("customer_id").isNotNull()).select("customer_id", "order_ts", "first_action_id")
    rows = Ordered(paid, "customer_id", "order_ts", "first_action_id", n=n)
    near = rows.neighbours(["customer_id"], previous={"_before": "order_ts"}, following={"_behind": "order_ts"})
    return near.select(
        "customer_id",
        "first_action_id",
        "order_ts",
        F.round(periods.days_between("_before", "order_ts"), 5).alias("days_since_previous"),
        F.round(periods.days_between("order_ts", "_behind"), 5).alias("days_to_next"),
    )


def avg_days_between_payments(donations: DataFrame) -> DataFrame:
    """Mean over users of the mean gap between consecutive paid donations, for users with a paid non-recurrent one.

    The gaps of one user add up to last minus first, so the mean gap needs three aggregates and no sorted window.
    """
    per_user = (
        donations.where(_paid() & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count_if(_paid_once()).alias("paid_once"),
            F.min("order_ts").alias("first_ts"),
            F.max("order_ts").alias("last_ts"),
            F.count("order_ts").alias("n_payments"),
        )
        .where((F.col("paid_once") > 0) & (F.col("n_payments") > 1))
    )
    mean_gap = periods.days_between("first_ts", "last_ts") / (F.col("n_payments") - 1)
    return per_user.agg(F.round(F.avg(mean_gap), 2).alias("overall_avg_days_between_payments"))


def paid_users_by_first_channel(donations: DataFrame, actions: DataFrame, years: list[int]) -> DataFrame:
    """Users with a paid donation by the channel of their first action; channels tied at the first moment all count.

    Actions are reduced to one row per user and channel before the first moment is found, so the window sees at most
    as many rows per user as there are channels.
    """
    per_channel = actions.groupBy("customer_id", "channel_name").agg(F.min("action_ts").alias("channel_first_ts"))
    user = Window.partitionBy("customer_id")
    first_channels = per_channel.withColumn("first_ts", F.min("channel_first_ts").over(user)).where(
        F.col("channel_first_ts") == F.col("first_ts")
    )
    per_year = (
        first_channels.join(sets.keys(donations.where(_paid())), "customer_id", "left_semi")
        .groupBy(F.col("channel_name").alias("user_source"), periods.year("first_ts").alias("_year"))
        .agg(F.count("*").alias("users_count"))
    )
    return pivots.count_pivot(per_year, "user_source", "_year", years, "users_count", total=True).orderBy(
        F.desc("total"), "user_source"
    )


NEVER = "9999-12-31 00:00:00"


def avg_days_first_to_second(donations: DataFrame, hot_share: float = 1e-4) -> DataFrame:
    """Mean days from a user's first paid non-recurrent donation to their next donation of any kind, whole days.

    The one metric that needs a user's rows after a fact about the user is known. Users with more than ``hot_share``
    of all rows are few, so their first moments are broadcast and their rows are never shuffled; the rows of all other
    users meet in a window, which then holds no large group.
    """
    dated = donations.where(F.col("customer_id").isNotNull() & F.col("order_ts").isNotNull()).select(
        "customer_id", "order_ts", F.when(_paid_once(), F.col("order_ts")).alias("paid_ts")
    )
    never = F.lit(NEVER).cast("timestamp_ntz")
    hot = skew.hot_keys(dated, "customer_id", hot_share, hot_first_ts=F.coalesce(F.min("paid_ts"), never))
    first_of_user = F.min("paid_ts").over(Window.partitionBy("customer_id"))
    of_hot = dated.join(hot, "customer_id").withColumnRenamed("hot_first_ts", "first_ts")
    of_others = (
        dated.join(hot, "customer_id", "left")
        .where(F.col("hot_first_ts").isNull())
        .withColumn("first_ts", first_of_user)
    )
    second = [
        rows.where(F.col("order_ts") > F.col("first_ts"))
        .groupBy("customer_id")
        .agg(F.min("first_ts").alias("first_ts"), F.min("order_ts").alias("second_ts"))
        for rows in (of_hot, of_others)
    ]
    days = F.avg(periods.days_between("first_ts", "second_ts"))
    both = second[0].unionByName(second[1])
    return both.agg(F.round(days).cast("bigint").alias("avg_days_between_1_and_2_payments"))
