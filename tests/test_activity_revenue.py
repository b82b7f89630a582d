import datetime as dt

from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.plans import activity, conversion, revenue

from .conftest import rows


def test_spine():
    spine = periods.Spine("2021-11", 4)
    assert spine.labels == ["2021-11", "2021-12", "2022-01", "2022-02"]
    assert periods.Spine("2021-01", 45).labels[-1] == "2024-09"


def test_spine_frame(spark):
    assert rows(periods.Spine("2021-11", 3).frame(spark.range(1))) == [
        (dt.date(2021, 11, 1),),
        (dt.date(2021, 12, 1),),
        (dt.date(2022, 1, 1),),
    ]


def test_year_ranges_are_pushed_to_the_scan(spark):
    from donorlens.sources import sample_tables

    from .conftest import SF_DIR

    d = sample_tables.donations(spark, SF_DIR)
    picked = d.where(periods.in_years("order_ts", [1995, 1996, 1998]))
    assert picked.count() == d.where("year(order_ts) IN (1995, 1996, 1998)").count()
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_fractional_days(donations):
    d = donations((1, "2021-01-01T00:00:00"), (1, "2021-01-02T06:00:00.000001"))
    days = d.agg(periods.days_between(F.min("order_ts"), F.max("order_ts")).alias("x")).first()["x"]
    assert abs(days - (1.25 + 1e-6 / 86400)) < 1e-12


def test_weeks_split_at_new_year(donations):
    d = donations((1, "2023-12-31"), (1, "2024-01-01"), (2, "2024-01-07"), (2, "2024-01-08"), (1, "2024-01-08"))
    # 2023: one day, week and month. 2024: days 1, 1, 2; week 01 has users 1 and 2, week 02 has both.
    assert rows(activity.activity_by_year(d)) == [
        ("2023", 1.0, 1.0, 1.0, 100.0, 100.0),
        ("2024", 1.33, 2.0, 2.0, 66.67, 66.67),
        ("Total", 1.25, 1.67, 1.5, 83.33, 75.0),
    ]
    assert [r[0] for r in rows(activity.activity_by_month(d))] == ["2023-12", "2024-01"]


def test_undated_rows_are_a_null_period_but_count_in_total(donations):
    d = donations((1, "2021-01-03"), (1, "2021-01-04"), (2, None), (3, None), (3, None), (None, "2021-01-03"))
    assert rows(activity.activity_by_year(d)) == [
        (None, None, None, None, None, None),
        ("2021", 1.0, 1.0, 1.0, 100.0, 100.0),
        ("Total", 1.33, 1.33, 1.5, 88.89, 100.0),
    ]


def test_conversion(donations, actions):
    a = actions((1, "2021-01-01"), (2, "2021-01-01"), (3, "2021-01-05"), (1, "2021-02-01"), (None, "2021-04-01"))
    d = donations((1, "2021-01-01"), (9, "2021-02-01"), (8, "2021-02-01"), (1, "2021-03-01"), (2, "2021-01-01", 5, "fail"))
    assert rows(conversion.conversion_rate(d, a)) == [(3, 3, 100.0)]
    assert rows(conversion.conversion_by_month(d, a)) == [
        ("2021-01", 3, 1, 33.33),
        ("2021-02", 1, 2, 200.0),
        ("2021-04", 0, 0, None),
    ]
    assert rows(conversion.avg_conversion_below_100(d, a)) == [(33.33,)]


def test_lifetime_value(donations):
    d = donations((1, "2021-01-01", 10), (1, "2021-01-31", 30), (2, "2021-05-01", 100), (3, "2022-05-01", 7))
    # 2021: (20 * 2 + 100 * 1) per one month; 2022: no lifetime at all
    assert rows(conversion.clv_by_year(d)) == [("2021", 140.0), ("2022", None)]


def test_revenue(donations, actions):
    d = donations(
        (1, "2021-01-01", 7), (2, "2021-01-01", 2), (1, "2022-03-01", 5), (1, "2022-03-01", 5, "fail"), (3, None, 4), (1, "2021-02-01", None)
    )
    a = actions((1, "2021-01-01"), (2, "2021-01-02"), (3, "2021-01-02"), (3, "2023-01-02"), (4, None))
    assert rows(revenue.total_paid(d)) == [(18.0,)]
    assert rows(revenue.total_paid(donations())) == [(None,)]
    assert rows(revenue.total_paid_by_year(d)) == [("2022", 5.0), ("2021", 9.0), (None, 4.0)]
    assert rows(revenue.arpu_by_year(d, a)) == [(None, 0.0, 1, 0.0), ("2021", 9.0, 3, 3.0), ("2023", 0.0, 1, 0.0)]
    assert rows(revenue.arpu_by_month(d, a))[1] == ("2021-01", 9.0, 3, 3.0)
    assert rows(revenue.arppu_by_year(d)) == [(None, 0.0, 1, 0.0), ("2021", 9.0, 2, 4.5), ("2022", 5.0, 1, 5.0)]
    assert rows(revenue.arppu_by_month(d))[1:3] == [("2021-01", 9.0, 2, 4.5), ("2021-02", 0.0, 1, 0.0)]
    assert rows(revenue.avg_check_by_year(d)) == [(None, 4.0), ("2021", 4.5), ("2022", 5.0), ("Total", 4.5)]
    assert rows(revenue.avg_daily_check(d)) == [(4.5,)]


def test_payments_and_lifetime(donations):
    d = donations((1, "2021-01-01"), (1, "2021-01-11T12:00:00"), (2, "2021-01-01"), (3, "2021-01-01", 1, "fail"))
    assert rows(revenue.avg_payments_and_lifetime(d)) == [(5.25, 1.5)]
