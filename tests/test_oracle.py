"""Every registered query against its DuckDB SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import oracle
from checks.compare import connect, difference
from donorlens.plans import users
from donorlens.sources import sample_tables

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(oracle.ORACLE) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle.ORACLE))
def test_matches_duckdb(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry(spark):
    result = entry(spark)
    assert result.count() > 0
    assert result.columns[:2] == ["customer_id", "recency_days"]


def test_ids_missing_on_both_sides(spark, con):
    """Events of all time against donations of one year: both tables have ids the other lacks."""
    events = sample_tables.events_as_actions(spark, SF_DIR)
    donations = sample_tables.donations(spark, SF_DIR).where("year(order_ts) = 1998")
    prefix = f"WITH {oracle.D.replace('FROM orders', 'FROM orders WHERE year(o_orderdate) = 1998')}, {oracle.EVENT_ACTIONS}"
    for metric, name in (
        (users.non_matched_ids, "non_matched_ids"),
        (users.non_matched_users_by_year, "non_matched_users_by_year"),
    ):
        sql = oracle.ORACLE[name].replace(f"WITH {oracle.D}, {oracle.EVENT_ACTIONS}", prefix)
        assert difference(metric(donations, events), con, sql) is None
    sources = {r["source"] for r in users.non_matched_users_by_year(donations, events).collect()}
    assert sources == {"customers_only", "orders_only"}
