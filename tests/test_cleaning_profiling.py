import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlens.operators import cleaning, histograms, profiling
from donorlens.sources import sample_tables

from .conftest import SF_DIR, rows


def test_drop_columns(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b")
    assert cleaning.drop_columns(df, ["b", "c"]).columns == ["a"]
    with pytest.raises(KeyError):
        cleaning.drop_columns(df, ["b", "c"], strict=True)


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "`a.b` int, gone string, kept string")
    assert cleaning.drop_empty_columns(df).columns == ["a.b", "kept"]
    assert cleaning.drop_empty_columns(df.limit(0)).columns == []


def test_duplicate_column(spark):
    same = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.9)], "price bigint, base double")
    assert cleaning.drop_if_duplicate(same, "price", "base").columns == ["price"]
    other = spark.createDataFrame([(1, 1.0), (None, 2.0)], "price bigint, base double")
    assert cleaning.drop_if_duplicate(other, "price", "base").columns == ["price", "base"]
    assert rows(cleaning.duplicate_check(other, "price", "base")) == [(2, 1)]


def test_timestamps(spark):
    df = spark.createDataFrame([("2021-03-04 05:06:07",), ("04.03.2021",), ("nonsense",), (None,)], "t string")
    assert rows(cleaning.to_timestamps(df, ["t"])) == [(dt.datetime(2021, 3, 4, 5, 6, 7),), (None,), (None,), (None,)]
    assert rows(cleaning.to_timestamps(df, ["t"], "dd.MM.yyyy"))[1] == (dt.datetime(2021, 3, 4),)


def test_integers(spark):
    texts = ["12", " -3 ", "6.9", "-6.9", "1e3", "9223372036854775807", "9223372036854775808", "abc", "", ".5", "5.", "0x1", None]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    got = [r["n"] for r in cleaning.to_integers(df, ["n"]).collect()]
    assert got == [12, -3, 6, -6, 1000, 9223372036854775807, None, None, None, 0, 5, None, None]
    with pytest.raises(Exception, match="not a number"):
        cleaning.to_integers(df, ["n"], strict=True).collect()
    numbers = spark.createDataFrame([(2.7,), (None,)], "n double")
    assert rows(cleaning.to_integers(numbers, ["n"])) == [(2,), (None,)]


def test_schema_reports(spark):
    before = spark.sql("SELECT 1 AS a, '2' AS b, 3 AS c")
    after = before.select("a", F.col("b").cast("int"))
    assert profiling.removed_columns(before, after) == ["c"]
    assert profiling.changed_types(before, after) == ["b"]
    assert profiling.changed_types(before, before) == []


def test_profile_and_null_rates(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, 1.0, "y")], "a int, b double, c string")
    assert rows(profiling.dataset_profile(df)) == [("a", "int", 3, 0), ("c", "string", 2, 1), ("b", "double", 1, 2)]
    assert rows(profiling.null_rates(df)) == [("a", 0.0), ("c", 33.33333), ("b", 66.66667)]
    assert rows(profiling.null_rates(df.limit(0)))[0] == ("a", None)


def test_values(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "v string")
    assert sorted(rows(profiling.distinct_values(df, "v")), key=str) == [("x",), ("y",), (None,)]
    assert rows(profiling.value_counts(df, "v")) == [("y", 2), ("x", 1)]


def test_random_rows(spark):
    df = spark.range(100).withColumn("twice", F.col("id") * 2)
    sample = rows(profiling.random_rows(df, ["id", "twice"], 5, seed=1))
    assert len(set(sample)) == 5 and all(b == 2 * a for a, b in sample)
    assert profiling.random_rows(df.limit(3), ["id"], 5).count() == 3


def test_row_delta(spark):
    assert rows(profiling.row_delta(spark.range(8), spark.range(7), "t")) == [("t", 8, 7, 12.5)]
    assert rows(profiling.row_delta(spark.range(0), spark.range(0), "t")) == [("t", 0, 0, None)]


def check_histogram(df, feature, max_bins=20):
    values = [float(r[0]) for r in df.select(feature).collect() if r[0] is not None]
    n_bins = min(max_bins, df.select(feature).distinct().count())
    want, edges = np.histogram(values, bins=n_bins)
    got = histograms.histogram_table(df.select(feature), max_bins=max_bins).collect()
    assert {r["bucket"]: r["n"] for r in got} == {i + 1: n for i, n in enumerate(want) if n}
    for r in got:
        assert r["feature"] == feature
        assert abs(r["lo"] - edges[r["bucket"] - 1]) < 1e-6 and abs(r["hi"] - edges[r["bucket"]]) < 1e-6
        assert r["median"] == statistics.median(values)
        assert abs(r["mean"] - statistics.fmean(values)) < 1e-6 * max(1, abs(r["mean"]))


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0],
        [1.0, 2.0, 2.0, 3.0, None],
        [0.0] * 50 + [1e9, 5.0, 7.0],
        [float(i * i % 101) for i in range(400)],
        [-5.5, 3.25, 3.25, 100.0, -5.5, 7.0, None, None],
        [1e-9, 1e9, 2e-9, 3e-9, 4e-9],
    ],
)
def test_histogram_matches_numpy(spark, values):
    check_histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x")


def test_histogram_of_table_columns(spark):
    orders = sample_tables.table(spark, SF_DIR, "orders")
    check_histogram(orders, "o_totalprice")
    check_histogram(orders.select((F.col("o_custkey") % 7).alias("k")), "k")


def test_histogram_leaves_out_constants_texts_and_excluded(spark):
    df = spark.createDataFrame([(1, 5, "a", True, 1.0), (2, 5, "b", False, 2.0)], "x int, same int, t string, f boolean, no double")
    assert {r["feature"] for r in histograms.histogram_table(df, exclude=["no"]).collect()} == {"x"}
    assert histograms.histogram_table(df.select("t", "f")).collect() == []
    assert histograms.histogram_table(df.limit(0)).collect() == []


def test_duplicate_column_keeps_fractions(spark):
    prices = spark.createDataFrame([("99.50", "99.70"), ("10.00", "10.40")], "price string, base string")
    assert rows(cleaning.duplicate_check(prices, "price", "base")) == [(2, 1)]
    assert cleaning.drop_if_duplicate(prices, "price", "base").columns == ["price", "base"]


def test_histogram_heavy_tail(spark, monkeypatch):
    """Two outliers put all other values into one equal-width bin; the range of the median still gets small."""
    monkeypatch.setattr(histograms, "MAX_RANKED", 500)
    df = spark.range(200_000).select(F.when(F.col("id") == 0, 1e18).when(F.col("id") == 1, 1e12).otherwise(F.col("id")).alias("x"))
    numbers = [histograms.as_number(df, "x")]
    features = histograms._features(df, ["x"], numbers, 20)
    histograms._counted(df, numbers, features, 20)
    (f,) = histograms.narrowed(df, numbers, features)
    assert f.inside <= 500 and f.below < f.ranks[0] and f.ranks[1] <= f.below + f.inside
    got = histograms.histogram_table(df).collect()
    assert {r["n"] for r in got} == {199_999, 1} and {r["median"] for r in got} == {100_001.5}


def test_histogram_of_one_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(histograms, "MAX_RANKED", 500)
    df = spark.range(50_000).select(F.when(F.col("id") < 40_000, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert {r["median"] for r in histograms.histogram_table(df).collect()} == {7.0}


def test_histogram_of_infinities_times_and_too_many_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),)], "x double")
    assert sum(r["n"] for r in histograms.histogram_table(df).collect()) == 2
    times = spark.sql("SELECT DATE'2021-01-01' AS d, TIMESTAMP_NTZ'2021-01-01 00:00:01' AS t UNION ALL SELECT DATE'2021-01-03', NULL UNION ALL SELECT NULL, TIMESTAMP_NTZ'2021-01-01 00:00:02'")
    got = {(r["feature"], r["bucket"]): r for r in histograms.histogram_table(times).collect()}
    assert got["d", 1]["median"] == dt.datetime(2021, 1, 2, tzinfo=dt.timezone.utc).timestamp()
    assert got["t", 1]["lo"] + 1 == got["t", 3]["hi"]
    with pytest.raises(ValueError):
        histograms.histogram_table(df, max_bins=65)
