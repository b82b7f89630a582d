from donorlens.plans import channels, recurring

from .conftest import rows


def test_recurrent_users(donations):
    d = donations(
        (1, "2021-01-01", 1, "Paid", False, True),
        (1, "2022-01-01", 1, "Paid", False, True),
        (2, "2022-01-01", 1, "fail", False, True),
        (3, None, 1, "Paid", False, True),
        (4, "2022-01-01", 1, "Paid", False, None),
    )
    assert rows(recurring.recurrent_users(d)) == [(3,)]
    assert rows(recurring.recurrent_users_by_first_year(d)) == [(None, 1), ("2021", 1), ("2022", 1)]


def test_repeat_payers(spark, donations):
    d = donations(
        (1, "2021-01-01"),
        (1, "2021-02-01", 1, "fail"),
        (2, "2021-01-01", 1, "Paid", False, True),
        (2, "2021-02-01", 1, "Paid", False, True),
        (3, "2021-01-01"),
        (None, "2021-01-01"),
        (None, "2021-02-01"),
    )
    assert rows(recurring.repeat_payers_non_recurrent(d)) == [(1,)]
    same_action = d.withColumn("first_action_id", d.website_id * 0)
    assert rows(recurring.repeat_payers_non_recurrent(same_action)) == [(0,)]


def test_days_between_payments(donations):
    d = donations(
        (1, "2021-01-01T00:00:00"),
        (1, "2021-01-02T12:00:00"),
        (1, "2021-01-05T00:00:00", 1, "fail"),
        (1, "2021-01-11T00:00:00", 1, "Paid", False, True),
        (1, None),
        (2, "2021-01-01"),
        (3, "2021-01-01"),
        (3, "2021-01-02"),
        (4, "2021-01-01", 1, "Paid", False, True),
        (4, "2021-03-01", 1, "Paid", False, True),
    )
    # user 1: gaps 1.5 and 8.5 days; user 2 has one payment; user 3: one day; user 4 is recurrent only
    assert rows(recurring.avg_days_between_payments(d)) == [(3.0,)]
    # user 1 goes on after 1.5 days, user 3 after one
    assert rows(recurring.avg_days_first_to_second(d)) == [(1,)]


def test_next_donation_needs_a_later_moment(donations):
    d = donations((1, "2021-01-01"), (1, "2021-01-01"), (2, "2021-01-01"), (2, "2021-01-04", 1, "fail"))
    assert rows(recurring.avg_days_first_to_second(d)) == [(3,)]


def test_single_payments_give_null(donations):
    d = donations((1, "2021-01-01"), (2, "2021-02-01"))
    assert rows(recurring.avg_days_between_payments(d)) == [(None,)]
    assert rows(recurring.avg_days_first_to_second(d)) == [(None,)]
    assert rows(recurring.avg_days_first_to_second(donations())) == [(None,)]


def test_hot_user_without_qualifying_payment(donations):
    d = donations(*[(1, f"2021-01-{i:02d}", 1, "fail") for i in range(1, 9)], (2, "2021-01-01"), (2, "2021-01-03"))
    assert rows(recurring.avg_days_first_to_second(d, hot_share=0.5)) == [(2,)]


def test_hot_users_are_split_without_changing_the_result(spark, donations):
    many = [(1, f"2021-01-{1 + i % 28:02d}T{i % 24:02d}:00:00") for i in range(300)]
    few = [(u, f"2021-0{1 + u % 8}-01") for u in range(2, 60)] + [(u, f"2021-09-{u % 27 + 1:02d}") for u in range(2, 60)]
    d = donations(*many, *few)
    plain = rows(recurring.avg_days_first_to_second(d, hot_share=1.0))
    assert rows(recurring.avg_days_first_to_second(d, hot_share=0.02)) == plain


def test_hot_keys(spark):
    from pyspark.sql import functions as F

    from donorlens.operators import skew

    raw = spark.createDataFrame([(1, i) for i in range(90)] + [(k, k) for k in range(2, 12)], "k int, v int")
    assert rows(skew.hot_keys(raw, "k", 0.1, top=F.max("v"))) == [(1, 89)]
    assert rows(skew.hot_keys(raw, "k", 1.0)) == []


def test_first_channel_ties_count_in_both(donations, actions):
    a = actions(
        (1, "2021-01-01", "site"),
        (1, "2021-01-01", "app"),
        (1, "2021-02-01", "mail"),
        (2, "2022-01-01", "app"),
        (2, "2022-01-01", "app"),
        (3, "2022-01-01", "app"),
        (4, "2020-01-01", "old"),
        (5, "2021-01-01", None),
        (6, None, "site"),
    )
    d = donations((1, "2023-01-01"), (1, "2023-01-01"), (2, "2023-01-01"), (3, "2023-01-01", 1, "fail"), (4,), (5,), (6,))
    assert rows(recurring.paid_users_by_first_channel(d, a, [2021, 2022])) == [
        ("app", 1, 1, 2),
        (None, 1, 0, 1),
        ("site", 1, 0, 1),
        ("old", 0, 0, 0),
    ]


def test_channel_pairs_multiply(donations, actions):
    a = actions((1, "2021-01-01", "x", "ads"), (1, "2021-05-01", "x", "ads"), (2, "2021-01-01", "x", "None"), (3, "2021-01-01", "x"))
    d = donations((1, "2022-01-01", 10), (1, "2022-01-02", 30), (1, "2022-01-03", 99, "fail"), (2,), (3,))
    assert rows(channels.top_channel_orders(d, a)) == [("2021", "ads", 1, 4, 20.0)]
    assert rows(channels.top_channels_by_year(d, a, [2021, 2022])) == [("None", 1, 0), ("ads", 1, 0)]
    assert rows(channels.top_channels_by_year(d, a, [2021], sentinels=["None", "none"])) == [("ads", 1)]


def test_unpaid_users_have_no_check(donations, actions):
    a, d = actions((1, "2021-01-01", "x", "ads")), donations((1, "2022-01-01", 10, "fail"))
    assert rows(channels.top_channel_orders(d, a)) == [("2021", "ads", 1, 0, None)]


def test_rank_cut_and_zero_fill(donations, actions):
    a = actions(*[(u, "2021-01-01", "x", s) for u, s in ((1, "a"), (2, "a"), (3, "b"), (4, "c"))], (1, "2022-01-01", "x", "c"))
    d = donations((1,), (2,), (3,), (4,))
    # in 2021 b and c tie for the second place: the name decides
    assert rows(channels.top_channels_by_year(d, a, [2021, 2022], k=2)) == [("a", 2, 0), ("b", 1, 0), ("c", 0, 1)]
