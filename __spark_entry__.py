
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks.oracle import ORACLE  # noqa: E402
from donorlens.functions import segments  # noqa: E402
from donorlens.functions.periods import Spine  # noqa: E402
from donorlens.operators import cleaning, histograms, observed, pivots, profiling  # noqa: E402
from donorlens.plans import (  # noqa: E402
    activity,
    campaign,
    channels,
    cohorts,
    conversion,
    payments,
    recurring,
    revenue,
    rfm,
    users,
)
from donorlens.schemas import PAID  # noqa: E402
from donorlens.sources import files, sample_tables, tables, versions  # noqa: E402
from donorlens.sources.sample_tables import NO_SOURCE, SPINE_MONTHS, SPINE_START, TOP_K, YEARS, table  # noqa: E402
from donorlens.sources.scratch import new_path  # noqa: E402

# The corpus operators are an optional part.
llm_queries = corpus_pipeline = None
if importlib.util.find_spec("donorlens.llm"):
    from donorlens.llm import queries as llm_queries

    if importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

Query = Callable[[SparkSession, str], DataFrame]

SPINE = Spine(SPINE_START, SPINE_MONTHS)


def entry(spark: SparkSession) -> DataFrame:
    """RFM segmentation of all donors."""
    return rfm.rfm_customers(sample_tables.donations(spark, "/root/testdata/sf0.001"))


def _of_donations(metric: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, sf_dir: metric(sample_tables.donations(spark, sf_dir), **params)


def _of_actions(metric: Callable[..., DataFrame], *columns: str, **params) -> Query:
    return lambda spark, sf_dir: metric(sample_tables.actions(spark, sf_dir, *columns), **params)


def _of_both(metric: Callable[..., DataFrame], *columns: str, **params) -> Query:
    return lambda spark, sf_dir: metric(
        sample_tables.donations(spark, sf_dir), sample_tables.actions(spark, sf_dir, *columns), **params
    )


def _with_events(metric: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: metric(
        sample_tables.donations(spark, sf_dir), sample_tables.events_as_actions(spark, sf_dir)
    )


def queries() -> dict[str, Query]:
    extra = dict(llm_queries.QUERIES) if llm_queries else {}
    if corpus_pipeline:
        extra["pipeline"] = corpus_pipeline.run
    return {
        **extra,
        # users
        "unique_action_users": _of_actions(users.unique_action_users),
        "unique_donors": _of_donations(users.unique_donors),
        "non_matched_ids": _with_events(users.non_matched_ids),
        "non_matched_users_by_year": _with_events(users.non_matched_users_by_year),
        # campaign
        "campaign_window": _of_donations(campaign.campaign_window),
        "campaign_users": _of_donations(campaign.campaign_users),
        "campaign_participation_pct": _of_donations(campaign.campaign_participation_pct),
        "campaign_users_by_first_action_year": _of_both(campaign.campaign_users_by_first_action_year),
        "campaign_returned_users": _of_donations(campaign.campaign_returned_users),
        "campaign_first_time_donors": _of_donations(campaign.campaign_first_time_donors),
        "campaign_first_time_returned": _of_donations(campaign.campaign_first_time_returned),
        # recurrent users, repeat payments
        "recurrent_users": _of_donations(recurring.recurrent_users),
        "recurrent_users_by_first_year": _of_donations(recurring.recurrent_users_by_first_year),
        "repeat_payers_non_recurrent": _of_donations(recurring.repeat_payers_non_recurrent),
        "avg_days_between_payments": _of_donations(recurring.avg_days_between_payments),
        "paid_users_by_first_channel": _of_both(recurring.paid_users_by_first_channel, "channel_name", years=YEARS),
        "avg_days_first_to_second": _of_donations(recurring.avg_days_first_to_second),
        # payment status
        "payments_by_status": _of_donations(payments.payments_by_status),
        "payments_by_status_year": _of_donations(payments.payments_by_status_year, years=YEARS),
        "users_by_status": _of_both(payments.users_by_status),
        "users_by_status_count": _of_both(payments.users_by_status_count),
        "users_by_status_year": _of_both(payments.users_by_status_year, years=YEARS),
        "revenue_by_status_year": _of_donations(payments.revenue_by_status_year),
        "max_donations": _of_donations(payments.max_donations),
        "paid_in_range": _of_donations(payments.paid_in_range),
        "unpaid_in_range": _of_donations(payments.unpaid_in_range),
        # channels
        "top_channels_by_year": _of_both(
            channels.top_channels_by_year, "utm_source", years=YEARS, k=TOP_K, sentinels=[NO_SOURCE]
        ),
        "top_channel_orders": _of_both(channels.top_channel_orders, "utm_source", k=TOP_K, sentinels=[NO_SOURCE]),
        # activity
        "activity_by_year": _of_donations(activity.activity_by_year),
        "activity_by_month": _of_donations(activity.activity_by_month),
        "activity_by_year_events": lambda s, d: activity.activity_by_year(sample_tables.events_as_donations(s, d)),
        "activity_by_month_events": lambda s, d: activity.activity_by_month(sample_tables.events_as_donations(s, d)),
        # conversion, lifetime value
        "conversion_rate": _of_both(conversion.conversion_rate),
        "conversion_by_month": _of_both(conversion.conversion_by_month),
        "avg_conversion_below_100": _of_both(conversion.avg_conversion_below_100),
        "clv_by_year": _of_donations(conversion.clv_by_year),
        # revenue
        "total_paid": _of_donations(revenue.total_paid),
        "total_paid_by_year": _of_donations(revenue.total_paid_by_year),
        "arpu_by_year": _of_both(revenue.arpu_by_year),
        "arpu_by_month": _of_both(revenue.arpu_by_month),
        "arppu_by_year": _of_donations(revenue.arppu_by_year),
        "arppu_by_month": _of_donations(revenue.arppu_by_month),
        "avg_check_by_year": _of_donations(revenue.avg_check_by_year),
        "avg_payments_and_lifetime": _of_donations(revenue.avg_payments_and_lifetime),
        "avg_daily_check": _of_donations(revenue.avg_daily_check),
        # RFM
        "rfm_customers": _of_donations(rfm.rfm_customers),
        "rfm_segments": _of_donations(rfm.rfm_segments),
        # cohorts
        "retention_matrix": _of_donations(cohorts.retention_matrix, spine=SPINE),
        "retention_long": _of_donations(cohorts.retention_long, spine=SPINE),
        "avg_retention_by_cohort": _of_both(cohorts.avg_retention_by_cohort),
        "top_bottom_retention": _of_both(cohorts.top_bottom_retention, k=TOP_K),
        "avg_orders_by_cohort": _of_both(cohorts.avg_orders_by_cohort),
        "top_bottom_avg_orders": _of_both(cohorts.top_bottom_avg_orders, k=TOP_K),
        "avg_orders_all_cohorts": _of_both(cohorts.avg_orders_all_cohorts),
        "avg_check_matrix": _of_donations(cohorts.avg_check_matrix, spine=SPINE),
        "avg_check_by_cohort": _of_donations(cohorts.avg_check_by_cohort, spine=SPINE),
        "top_bottom_avg_check": _of_donations(cohorts.top_bottom_avg_check, spine=SPINE, k=TOP_K),
        "ltv_matrix": _of_donations(cohorts.ltv_matrix, spine=SPINE),
        "ltv_running": _of_donations(cohorts.ltv_running, spine=SPINE),
        "ltv_by_cohort": _of_donations(cohorts.ltv_by_cohort),
        "ltv_by_cohort_per_user": _of_donations(cohorts.ltv_by_cohort, per_user=True),
        "top_bottom_ltv": _of_donations(cohorts.top_bottom_ltv, k=TOP_K),
        # cleaning and profiling operators
        "null_rates": _null_rates,
        "dataset_profile": lambda s, d: profiling.dataset_profile(table(s, d, "part")),
        "distinct_values": lambda s, d: profiling.distinct_values(table(s, d, "orders"), "o_orderpriority"),
        "value_counts": lambda s, d: profiling.value_counts(table(s, d, "lineitem"), "l_returnflag"),
        "row_delta": _row_delta,
        "histogram_table": _histogram_table,
        "histogram_of_times": _histogram_of_times,
        "duplicate_column_check": _duplicate_column_check,
        "coerce_types": _coerce_types,
        "drop_empty_columns": _drop_empty_columns,
        "rearranged_matrix": lambda s, d: pivots.newest_first(
            cohorts.retention_matrix(sample_tables.donations(s, d), SPINE)
        ),
        "union_by_name": _union_by_name,
        "segment_labels": _segment_labels,
        # whole tables in order
        "payment_gaps": _of_donations(recurring.payment_gaps),
        "running_revenue": _of_donations(revenue.running_revenue),
        "donation_ranks": _of_donations(revenue.donation_ranks),
        # sources, tables, reports
        "csv_round_trip": _csv_round_trip,
        "load_report": _load_report,
        "published_tables": _published_tables,
        "sql_with_parameters": _sql_with_parameters,
        "view_of_payers": _view_of_payers,
        "drop_columns_lenient": lambda s, d: cleaning.drop_columns(table(s, d, "customer"), ["c_mktsegment", "c_nothing"]),
        "drop_columns_strict": lambda s, d: cleaning.drop_columns(table(s, d, "part"), ["p_brand"], strict=True),
        "schema_changes": _schema_changes,
        "random_customers": lambda s, d: profiling.random_rows(
            table(s, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"], n=50, seed=7
        ),
        "random_orders_by_status": lambda s, d: profiling.random_rows_by(
            table(s, d, "orders"), "o_orderstatus", ["o_orderkey", "o_custkey"], n=20, seed=7
        ),
    }


def _null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return profiling.null_rates(customers.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))))


def _row_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    donations = sample_tables.donations(spark, sf_dir)
    return profiling.row_delta(donations, donations.where(F.col("status") == PAID), "orders")


def _histogram_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
    bins = histograms.histogram_table(table(spark, sf_dir, "lineitem"), exclude=others)
    # Doubles summed in another order differ in their last digits.
    return bins.withColumn("mean", F.round("mean", 4))


def _histogram_of_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.histogram_table(table(spark, sf_dir, "orders").select("o_orderdate")).withColumn("mean", F.round("mean", 4))


def _duplicate_column_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity")
    return cleaning.duplicate_check(
        lines.select(
            # A fraction, which the whole number of the copy never equals.
            (quantity + F.when(F.col("l_linenumber") == 6, 0.5).otherwise(0)).alias("quantity"),
            F.when(F.col("l_returnflag") != "R", quantity + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("copy"),
        ),
        "quantity",
        "copy",
    )


def _coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").cast("string").alias("number_text"),
        F.col("event_type").alias("bad_number"),
        F.col("ts").cast("string").alias("time_text"),
        F.col("props").alias("bad_time"),
    )
    return cleaning.to_timestamps(cleaning.to_integers(raw, ["number_text", "bad_number"]), ["time_text", "bad_time"])


def _text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an export has them: texts, of which some are no numbers or times."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("id_copy"),
        F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("string")).alias("moment"),
        F.lit(None).cast("string").alias("note"),
    )


def _load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of a load, from counts that were gathered while its export was staged."""
    text = _text_export(spark, sf_dir)
    converted = {"user": cleaning.whole_number(F.col("user")), "moment": cleaning.moment_of("moment")}
    staged, counts = observed.written(text, new_path(spark, "load-report"), converted, [("id", "id_copy")])
    filled = cleaning.drop_empty_columns(staged, counts.non_null)
    kept = cleaning.drop_if_duplicate(filled, "id", "id_copy", counts.different["id", "id_copy"])
    cleaned = cleaning.to_timestamps(cleaning.to_integers(kept, ["user"]), ["moment"])
    delta = counts.row_delta(cleaned, "export").select("rows_before", "rows_after")
    lost = spark.createDataFrame(list(counts.lost().items()), "column string, lost double")
    profile = counts.profile(cleaned).join(counts.null_rates(cleaned), "column").join(lost, "column", "left")
    return profile.crossJoin(F.broadcast(delta)).withColumn("lost", F.round("lost", 5))


def _published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donations and actions, published together twice and read by the pointer."""
    donations, events = sample_tables.donations(spark, sf_dir), sample_tables.events_as_actions(spark, sf_dir)
    store = new_path(spark, "published")
    versions.publish(spark, store, {"donations": donations.where(F.col("status") == PAID), "actions": events})
    versions.publish(spark, store, {"donations": donations})
    now = versions.tables(spark, store)
    payers = now["donations"].groupBy("customer_id").agg(F.count("*").alias("n_donations"))
    return payers.join(now["actions"].groupBy("customer_id").agg(F.count("*").alias("n_actions")), "customer_id", "full")


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as delimited files, found by name and read again."""
    customers = table(spark, sf_dir, "customer")
    folder = new_path(spark, "csv")
    customers.write.options(sep=";", header=True, escape='"').csv(folder)
    return files.read_routed(spark, folder, "PART-", customers.schema)[0]


def _sql_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register({"given_orders": table(spark, sf_dir, "orders")})
    query = """
        SELECT o_custkey AS customer_id, count(*) AS n_orders, max(o_orderkey) AS last_order
        FROM IDENTIFIER(:source) WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY o_custkey
    """
    return tables.run_sql(spark, query, {"source": "given_orders", "least": 1000, "status": "F"})


def _view_of_payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    donations = sample_tables.donations(spark, sf_dir)
    tables.register({"paid_donations": donations.where(F.col("status") == PAID)})
    return tables.run_sql(spark, "SELECT customer_id, count(*) AS n_paid FROM paid_donations GROUP BY customer_id")


def _schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _text_export(spark, sf_dir)
    after = cleaning.to_timestamps(cleaning.to_integers(cleaning.drop_columns(before, ["note", "id_copy"]), ["user"]), ["moment"])
    return profiling.schema_changes(before, after)


def _drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_empty_columns(table(spark, sf_dir, "supplier").withColumn("s_note", F.lit(None).cast("string")))


def _union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    in_credit = customers.where(F.col("c_acctbal") >= 0).select("c_custkey", "c_name", "c_mktsegment")
    in_debt = customers.where(F.col("c_acctbal") < 0).select("c_acctbal", "c_custkey", "c_name")
    return files.union_all([in_credit, in_debt])


def _segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = rfm.rfm_score(rfm.rfm_base(sample_tables.donations(spark, sf_dir))).select("RFM").distinct()
    return codes.select(
        "RFM",
        segments.segment_name(F.col("RFM")).alias("segment_name"),
        segments.segment_description(F.col("RFM")).alias("segment_description"),
    )


def oracle_sql() -> dict[str, str]:
    extra = dict(llm_queries.ORACLE) if llm_queries else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**ORACLE, **extra}
