"""The shape of the physical plans: what a metric may scan, join and sort."""

import re

import pytest

from __spark_entry__ import queries
from checks.oracle import ORACLE

from .conftest import SF_DIR


def plan_of(spark, name):
    return queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(spark, name) for name in ORACLE}


def test_no_python_and_no_cartesian_product(plans):
    for name, plan in plans.items():
        assert not re.search(r"Python|ArrowEval|InPandas|CartesianProduct", plan), name


@pytest.mark.parametrize(
    "name",
    ["activity_by_year", "campaign_returned_users", "repeat_payers_non_recurrent", "avg_days_between_payments", "clv_by_year"],
)
def test_donations_are_not_joined_to_themselves(plans, name):
    assert "Join" not in plans[name] and "Window" not in plans[name], name


@pytest.mark.parametrize("name", ["rfm_customers", "rfm_segments"])
def test_rfm_sorts_nothing_per_customer(plans, name):
    assert "Window" not in plans[name]


@pytest.mark.parametrize(
    "name",
    ["rfm_segments", "retention_matrix", "activity_by_month", "campaign_returned_users", "clv_by_year", "unique_action_users"],
)
def test_raw_rows_combine_before_their_first_shuffle(plans, name):
    """Going down the plan, the last shuffle above each scan sits on a partial aggregate."""
    lines = plans[name].splitlines()
    shuffles = []
    for i, line in enumerate(lines):
        if "Exchange" in line:
            shuffles.append(i)
        elif "FileScan" in line and "BroadcastExchange" not in lines[shuffles[-1]]:
            assert "Aggregate" in lines[shuffles[-1] + 1], lines[shuffles[-1]]


def test_scans_read_only_needed_columns(plans):
    assert "ReadSchema: struct<o_custkey:bigint>" in plans["unique_donors"]
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plans["total_paid"]
    assert "customer.parquet" not in plans["conversion_rate"]


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [EqualNullSafe(o_orderstatus,F)]" in plans["total_paid"]
    assert "EqualTo(o_orderpriority,2-HIGH)" in plans["recurrent_users"]
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00)" in plans["payments_by_status_year"]


def test_top_k_per_group_is_cut_before_the_shuffle(plans):
    assert "WindowGroupLimit" in plans["top_channels_by_year"]
    assert "TakeOrderedAndProject" in plans["top_bottom_retention"]


def test_hot_keys_take_no_scan_of_their_own(spark):
    """The rows of hot users, those of others, and the counts behind both."""
    df = queries()["avg_days_first_to_second"](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"(?<!Reused)FileScan", final)) <= 3
