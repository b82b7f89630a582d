from donorlens.operators import sets
from donorlens.plans import campaign, payments, users

from .conftest import rows, when


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_unmatched_ids_keep_duplicates(donations, actions):
    d, a = donations((2,), (3,), (3,), (7,)), actions((1,), (2,), (2,), (5,))
    assert ids(users.non_matched_ids(d, a)) == [1, 3, 3, 5, 7]
    assert rows(users.non_matched_users_by_year(d, a)) == [(None, 2, "customers_only"), (None, 2, "orders_only")]


def test_one_null_id_empties_not_in(donations, actions):
    d, a = donations((2,), (3,), (None,)), actions((1,), (2,), (None,))
    assert ids(users.non_matched_ids(d, a)) == []
    assert ids(users.non_matched_ids(d, a, ignore_null_ids=True)) == [1, 3]
    # Null ids form an unmatched row but no user.
    assert rows(users.non_matched_users_by_year(d, a)) == [(None, 1, "customers_only"), (None, 1, "orders_only")]


def test_null_id_on_the_left_only_is_dropped(donations, actions):
    assert ids(users.non_matched_ids(donations((2,)), actions((1,), (2,), (None,)))) == [1]
    assert ids(sets.not_in(sets.key_counts(actions((1,), (None,))), donations((2,)))) == [1]


def test_not_in_an_empty_table_keeps_null(donations, actions):
    unmatched = users.non_matched_ids(donations(), actions((1,), (None,))).collect()
    assert sorted((r[0] is None, r[0]) for r in unmatched) == [(False, 1), (True, None)]


def test_repeat_rows_spreads_large_counts(spark):
    counts = spark.createDataFrame([(1, 25), (2, 1), (None, 3)], "customer_id bigint, n_rows bigint")
    repeated = sets.repeat_rows(counts, chunk=10)
    assert sorted(rows(repeated.groupBy("customer_id").count()), key=str) == [(1, 25), (2, 1), (None, 3)]


def test_unmatched_years(donations, actions):
    d = donations((3, "2021-05-01"), (3, "2021-06-01"), (3, "2022-01-01"), (4, "2022-02-01"), (1, "2022-03-01"))
    a = actions((1, "2021-01-01"), (9, "2021-01-01"))
    assert rows(users.non_matched_users_by_year(d, a)) == [
        (None, 1, "customers_only"),
        ("2021", 1, "orders_only"),
        ("2022", 2, "orders_only"),
    ]


def test_view_exists_once(spark, donations, actions):
    import pytest
    from pyspark.errors import AnalysisException

    d, a = donations((2,)), actions((1,), (2,))
    users.create_non_matched_view(d, a, "unmatched_once")
    assert ids(spark.table("unmatched_once")) == [1]
    with pytest.raises(AnalysisException):
        users.create_non_matched_view(d, a, "unmatched_once")


def test_campaign(donations, actions):
    d = donations(
        # user 1: two campaign rows, first order is in the campaign, gives again after it
        (1, "2021-12-10", 100, "Paid", True),
        (1, "2021-12-20", 50, "notpaid", True),
        (1, "2022-05-01", 200, "Paid", False),
        # user 2: known before the campaign
        (2, "2021-01-01", 10, "Paid", False),
        (2, "2021-12-31", 20, "fail", True),
        # user 3: one campaign row and nothing else; no actions
        (3, "2021-12-15", 30, "Paid", True),
        # user 4: never in the campaign; null flag matches neither side
        (4, "2021-12-15", 40, "Paid", None),
    )
    a = actions((1, "2020-03-01"), (1, "2021-03-01"), (2, "2021-02-02"), (4, "2021-01-01"))
    assert rows(campaign.campaign_window(d)) == [(when("2021-12-10"), when("2021-12-31"))]
    assert rows(campaign.campaign_users(d)) == [(3,)]
    assert rows(campaign.campaign_participation_pct(d)) == [(75.0,)]
    assert rows(campaign.campaign_users_by_first_action_year(d, a)) == [
        ("2020", 1, 350.0, 300.0, 85.71),
        ("2021", 1, 30.0, 10.0, 33.33),
    ]
    assert rows(campaign.campaign_returned_users(d)) == [(1,)]
    assert rows(campaign.campaign_first_time_donors(d)) == [(3,)]
    assert rows(campaign.campaign_first_time_donors(d, distinct=True)) == [(2,)]
    assert rows(campaign.campaign_first_time_returned(d)) == [(1,)]


def test_campaign_without_plans_is_zero_percent(donations, actions):
    d = donations((1, "2021-12-10", 0, "Paid", True), (2, "2021-12-10", None, "Paid", True))
    a = actions((1, "2020-03-01"), (2, "2021-03-01"))
    assert rows(campaign.campaign_users_by_first_action_year(d, a)) == [
        ("2020", 1, 0.0, 0.0, 0.0),
        ("2021", 1, None, None, 0.0),
    ]


def test_no_campaign(donations):
    d = donations((1, "2021-12-10"))
    assert rows(campaign.campaign_first_time_donors(d)) == [(0,)]
    assert rows(campaign.campaign_first_time_returned(d)) == [(0,)]
    assert rows(campaign.campaign_participation_pct(d)) == [(0.0,)]
    assert rows(campaign.campaign_participation_pct(donations())) == [(None,)]


def test_statuses(donations, actions):
    d = donations(
        (1, "2021-01-01", 600, "Paid"),
        (1, "2022-01-01", 500, "notpaid"),
        (2, "2021-06-01", 700, "notpaid"),
        (3, "2021-07-01", 100, None),
        (4, None, 300000, "Paid"),
        (None, "2021-08-01", 10, "fail"),
    )
    a = actions((1,), (1,), (2,), (3,), (8,))
    assert rows(payments.payments_by_status(d)) == [("Paid", 2), ("notpaid", 2), (None, 1), ("fail", 1)]
    assert rows(payments.payments_by_status_year(d, [2021, 2022])) == [
        (None, 1, 0),
        ("Paid", 1, 0),
        ("fail", 1, 0),
        ("notpaid", 1, 1),
    ]
    assert rows(payments.users_by_status(d, a)) == [("notpaid", 2), (None, 1), ("Paid", 1)]
    assert rows(payments.users_by_status_count(d, a)) == [(0, 1), (1, 1), (2, 1)]
    assert rows(payments.users_by_status_year(d, a, [2021])) == [(None, 1), ("Paid", 1), ("notpaid", 1)]
    assert rows(payments.revenue_by_status_year(d)) == [
        (None, 300000.0, 300000.0, 0.0, 0.0),
        ("2021", 1410.0, 600.0, 700.0, 10.0),
        ("2022", 500.0, 0.0, 500.0, 0.0),
    ]
    assert rows(payments.max_donations(d)) == [(300000.0, 300000.0, 700.0)]
    assert rows(payments.paid_in_range(d)) == [(1,)]
    assert rows(payments.unpaid_in_range(d)) == [(1,)]


def test_status_totals_add_up(spark):
    from pyspark.sql import functions as F

    from donorlens.sources import sample_tables

    from .conftest import SF_DIR

    by_year = payments.revenue_by_status_year(sample_tables.donations(spark, SF_DIR))
    gap = F.abs(F.col("total_amount") - F.col("total_paid") - F.col("total_not_paid") - F.col("total_failed"))
    assert by_year.where(gap > 0.005).count() == 0
