from pyspark.sql import functions as F

from donorlens.functions import segments
from donorlens.functions.periods import Spine
from donorlens.operators import pivots, ranking
from donorlens.plans import cohorts, rfm
from donorlens.sources import sample_tables

from .conftest import SF_DIR, rows


def test_base(donations):
    d = donations(
        # two equal donations on one day collapse, the unequal one stays and adds a gap of zero days
        (1, "2021-01-01T08:00:00", 10),
        (1, "2021-01-01T09:00:00", 10),
        (1, "2021-01-01T10:00:00", 20),
        (1, "2021-01-11", 10),
        (2, "2021-01-05", 5),
        (3, "2021-01-31", 5),
        (4, "2021-01-07", 5, "fail"),
        (5, "2021-01-02", 5),
        (5, "2021-01-02", 6),
        (None, "2021-01-03", 5),
    )
    base = {r["customer_id"]: r for r in rfm.rfm_base(d).collect()}
    assert set(base) == {1, 2, 5}  # 3 gave on the very last day
    assert (base[1]["recency_days"], base[1]["order_frequency_per_month"], base[1]["total_spent"]) == (20, 6.0, 40)
    assert base[2]["order_frequency_per_month"] is None
    assert base[5]["order_frequency_per_month"] is None  # only a gap of zero days
    scored = {r["customer_id"]: r["RFM"] for r in rfm.rfm_customers(d).collect()}
    assert scored == {1: "312", 2: "244", 5: "244"}


def test_scores(spark):
    base = spark.createDataFrame(
        [(1, 10, 1.0, 10), (2, 10, 4.0, 10), (3, 100, None, 100), (4, 40, 1.0, 40)],
        "customer_id bigint, recency_days bigint, order_frequency_per_month double, total_spent int",
    ).withColumn("total_spent", F.col("total_spent").cast("decimal(28,2)"))
    # means: recency 40, frequency 2, spent 40
    codes = {r["customer_id"]: r["RFM"] for r in rfm.rfm_score(base).collect()}
    assert codes == {1: "344", 2: "324", 3: "142", 4: "341"}


def test_shares_add_up(spark):
    customers = rfm.rfm_customers(sample_tables.donations(spark, SF_DIR))
    codes = customers.select("RFM", "percentage_RFM").distinct()
    assert abs(codes.agg(F.sum("percentage_RFM")).first()[0] - 100) < 0.5
    assert customers.count() == rfm.rfm_base(sample_tables.donations(spark, SF_DIR)).count()


def test_all_codes(spark):
    digits = [str(d) for d in range(1, 5)]
    codes = [r + f + m for r in digits for f in digits for m in digits]
    named = spark.createDataFrame([(c,) for c in codes], "code string").select(
        "code", segments.segment_name(F.col("code")).alias("name"), segments.segment_description(F.col("code")).alias("text")
    )
    got = {r["code"]: (r["name"], r["text"]) for r in named.collect()}
    sizes = {}
    for name, _ in got.values():
        sizes[name] = sizes.get(name, 0) + 1
    assert sizes == {
        "Key clients": 9,
        "Prospective clients": 7,
        "One-time donors": 6,
        "Rarely active": 10,
        "Moderately active": 7,
        "Growth potential clients": 1,
        "Highly active": 3,
        "Lost clients": 21,
    }
    assert got["112"][0] == "Prospective clients" and got["213"][0] == "Prospective clients"
    assert got["243"] == (
        "Key clients",
        "Relatively active clients with extremely low transfer frequency and high donation amounts",
    )
    churned = {text for code, (_, text) in got.items() if code[0] == "4"}
    assert churned == {"Churned clients with extremely low transfer frequency and extremely small donation amounts"}
    assert got["444"][0] == "Rarely active" and got["411"][0] == "Lost clients"


def gifts(donations):
    return donations(
        (1, "2021-01-05", 10),
        (1, "2021-01-06", 20),
        (2, "2021-01-07", 30, "fail"),
        (1, "2021-03-01", 5),
        (3, "2021-03-02", 8),
        (4, "2020-12-01", 100),
        (4, "2021-01-01", 1),
        (None, "2021-02-01", 50),
        (5, None, 50),
    )


SPINE = Spine("2021-01", 3)


def test_retention(donations):
    d = gifts(donations)
    assert rows(cohorts.retention_matrix(d, SPINE)) == [
        ("2020-12", 1, 100.0, None, None),
        ("2021-01", 2, 100.0, None, 50.0),
        ("2021-03", 1, None, None, 100.0),
    ]
    assert rows(cohorts.retention_long(d, SPINE).orderBy("cohort", "month"))[1] == ("2021-01", 2, "2021-01", 2, 100.0)
    newest = pivots.newest_first(cohorts.retention_matrix(d, SPINE))
    assert newest.columns == ["cohort", "n_customers_start", "2021-03", "2021-02", "2021-01"]


def test_average_check(donations):
    d = gifts(donations)
    assert rows(cohorts.avg_check_matrix(d, SPINE)) == [
        ("2020-12", 1, 1.0, None, None, 1.0),
        ("2021-01", 2, 30.0, None, 5.0, 17.5),
        ("2021-03", 1, None, None, 8.0, 8.0),
    ]
    # February has no donations: a row without cohort
    assert rows(cohorts.avg_check_by_cohort(d, SPINE)) == [(None, 0.0), ("2020-12", 1.0), ("2021-01", 17.5), ("2021-03", 8.0)]
    assert rows(cohorts.avg_check_by_cohort(d, SPINE, drop_empty=True))[0] == ("2020-12", 1.0)
    assert rows(cohorts.top_bottom_avg_check(d, SPINE, k=1)) == [("2021-01", 17.5, "top"), (None, 0.0, "bottom")]
    # fewer rows than 2k: each row once, top wins
    assert [r[2] for r in rows(cohorts.top_bottom_avg_check(d, SPINE, k=3))] == ["top", "top", "top", "bottom"]


def test_lifetime_value(donations):
    d = gifts(donations)
    assert rows(cohorts.ltv_matrix(d, SPINE)) == [
        ("2020-12", 1, 1.0, None, None),
        ("2021-01", 1, 60.0, None, 65.0),
        ("2021-03", 1, None, None, 8.0),
    ]
    assert rows(cohorts.ltv_matrix(d, SPINE, per_user=True))[1] == ("2021-01", 2, 30.0, None, 32.5)
    assert rows(cohorts.ltv_running(d, SPINE)) == [
        (None, None, "2021-02", 0.0),
        ("2020-12", 1, "2021-01", 1.0),
        ("2021-01", 2, "2021-01", 60.0),
        ("2021-01", 2, "2021-03", 65.0),
        ("2021-03", 1, "2021-03", 8.0),
    ]
    # not clipped to the spine
    assert rows(cohorts.ltv_by_cohort(d)) == [("2020-12", 101.0), ("2021-01", 65.0), ("2021-03", 8.0)]
    assert rows(cohorts.ltv_by_cohort(d, per_user=True))[1] == ("2021-01", 32.5)
    assert rows(cohorts.top_bottom_ltv(d, k=1)) == [("2020-12", 101.0, "top"), ("2021-03", 8.0, "bottom")]


def test_running_value_never_falls(spark):
    d = sample_tables.donations(spark, SF_DIR)
    from pyspark.sql import Window

    running = cohorts.ltv_running(d, Spine("1995-01", 80), drop_empty=True)
    before = F.lag("ltv").over(Window.partitionBy("cohort").orderBy("order_month"))
    assert running.withColumn("before", before).where("before > ltv").count() == 0


def test_own_month_is_100_percent(spark):
    long = cohorts.retention_long(sample_tables.donations(spark, SF_DIR), Spine("1995-01", 80))
    assert long.where("cohort = month AND retention_rate <> 100").count() == 0


def test_action_cohorts(donations, actions):
    a = actions((1, "2021-01-09"), (1, "2021-05-01"), (2, "2021-01-02"), (3, "2021-02-01"), (4, None))
    d = donations((1, "2021-01-01"), (1, "2021-02-01"), (1, "2021-02-02", 1, "fail"), (9, "2021-02-02"))
    # January: months 2021-01 and 2021-02 with one of two users, and the empty month of user 2 with none
    assert rows(cohorts.avg_retention_by_cohort(d, a)) == [("2021-01", 2, 33.33), ("2021-02", 1, 0.0)]
    assert rows(cohorts.avg_retention_by_cohort(d, a, include_inactive=False)) == [("2021-01", 2, 50.0)]
    assert rows(cohorts.avg_orders_by_cohort(d, a)) == [(None, 0.0), ("2021-01", 1.5), ("2021-02", 0.0)]
    assert rows(cohorts.avg_orders_all_cohorts(d, a)) == [(0.5,)]
    assert rows(cohorts.top_bottom_retention(d, a)) == []
    assert rows(cohorts.top_bottom_retention(d, a, min_months=2)) == [
        ("2021-01", 2, 33.33, "bottom"),
        ("2021-01", 2, 33.33, "top"),
    ]
    assert rows(cohorts.top_bottom_avg_orders(d, a, k=1)) == [("2021-01", 1.5, "top"), (None, 0.0, "bottom")]


def test_limit_keeps_a_row_on_both_ends_and_rank_does_not(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    both = ranking.top_bottom_limit(df, "v", "k", 2)
    assert sorted(rows(both)) == [("a", 1.0, "bottom"), ("b", 2.0, "bottom"), ("b", 2.0, "top"), ("c", 3.0, "top")]
    once = ranking.top_bottom_rank(df, "v", "k", 2)
    assert sorted(rows(once)) == [("a", 1.0, "bottom"), ("b", 2.0, "top"), ("c", 3.0, "top")]
