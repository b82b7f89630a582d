"""Ranks, running sums and neighbours over whole tables, against plain Python."""

import random
import re
from decimal import Decimal

import pytest

from __spark_entry__ import queries
from donorlens.operators.ordered import PART, Ordered
from donorlens.plans import recurring

from .conftest import SF_DIR, rows

SCHEMA = "key int, at int, id int, amount decimal(10,2)"


def table(spark, n=400, hot=0.4):
    rng = random.Random(4)
    made = []
    for i in range(n):
        key = 7 if rng.random() < hot else rng.choice([None, 1, 2, 3, 9, 12])
        made.append((key, rng.choice([None, *range(6)]), i, None if i % 11 == 0 else Decimal(rng.randint(-500, 500)) / 100))
    rng.shuffle(made)
    return spark.createDataFrame(made, SCHEMA), made


def first_nulls(row, *places):
    return tuple((row[p] is not None, row[p] or 0) for p in places)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_running_sums(spark, n):
    df, made = table(spark)
    got = Ordered(df, "at", "id", n=n).running(total="amount")
    want, total = [], None
    for nr, row in enumerate(sorted(made, key=lambda r: first_nulls(r, 1, 2)), 1):
        if row[3] is not None:
            total = row[3] + (total or 0)
        want.append((*row, nr, total))
    assert sorted(rows(got), key=lambda r: r[4]) == want


@pytest.mark.parametrize("n", [1, 3, 40])
def test_ranks_of_ties_that_span_ranges(spark, n):
    df, made = table(spark)
    got = {r["id"]: (r["row_number"], r["rank"]) for r in Ordered(df, "at", "id", n=n).ranked("at").collect()}
    ordered = sorted(made, key=lambda r: first_nulls(r, 1, 2))
    for nr, row in enumerate(ordered, 1):
        assert got[row[2]] == (nr, 1 + sum(first_nulls(o, 1) < first_nulls(row, 1) for o in ordered))
    one_value = Ordered(spark.range(90).selectExpr("1 AS v", "id"), "v", "id", n=9).ranked("v")
    assert sorted(tuple(r) for r in one_value.select("row_number", "rank").collect()) == [(i, 1) for i in range(1, 91)]


def test_descending_ranks_put_nulls_last(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 5)], "id int, v int")
    got = Ordered(df, ("v", "desc"), "id", n=3).ranked("v").select("id", "row_number", "rank")
    assert sorted(rows(got)) == [(1, 2, 2), (2, 4, 4), (3, 1, 1), (4, 3, 2)]
    with pytest.raises(ValueError, match="first columns"):
        Ordered(df, "id").ranked("v")


@pytest.mark.parametrize("n", [1, 3, 40])
def test_neighbours(spark, n):
    df, made = table(spark)
    got = Ordered(df, "key", "at", "id", n=n).neighbours(["key"], previous={"p": "id", "pa": "amount"}, following={"f": "at"})
    ordered = sorted(made, key=lambda r: first_nulls(r, 0, 1, 2))
    want = {}
    for i, row in enumerate(ordered):
        before = ordered[i - 1] if i and ordered[i - 1][0] == row[0] else (None,) * 4
        behind = ordered[i + 1] if i + 1 < len(ordered) and ordered[i + 1][0] == row[0] else (None,) * 4
        want[row[2]] = (*row, before[2], before[3], behind[1])
    assert {r["id"]: tuple(r) for r in got.collect()} == want


def test_a_hot_key_spans_ranges(spark):
    df, _ = table(spark, 2000, hot=0.5)
    rows_of = Ordered(df, "key", "at", "id", n=20).rows
    assert rows_of.where("key = 7").select(PART).distinct().count() >= 8
    assert rows_of.groupBy(PART).count().agg({"count": "max"}).first()[0] < 400


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Ordered(empty, "at").running(total="amount").collect() == []
    assert Ordered(empty, "at").ranked("at").collect() == []
    assert Ordered(empty, "at").neighbours(["at"], {"p": "id"}).collect() == []


def test_gaps_of_one_user(donations):
    table = donations((1, "2021-01-01 00:00:00"), (1, "2021-01-01 12:00:00"), (1, "2021-01-01 12:00:00"), (None, "2021-01-01"), (2, "2021-01-01", 5, "fail"))
    got = recurring.payment_gaps(table, n=3).orderBy("first_action_id")
    assert [tuple(r)[3:] for r in got.collect()] == [(None, 0.5), (0.5, 0.0), (0.0, None)]


@pytest.mark.parametrize("name", ["payment_gaps", "running_revenue", "donation_ranks"])
def test_no_window_over_all_rows(spark, name):
    """Only the one row that each range sends goes to a single task."""
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert PART in line
    physical = df._jdf.queryExecution().executedPlan().toString()
    lines = physical.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert re.search(r"HashAggregate\(keys=\[_part|SortAggregate\(key=\[_part", "\n".join(lines[i + 1 : i + 4])), line
