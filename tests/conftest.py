import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from donorlens.schemas import ACTIONS, DONATIONS  # noqa: E402
from donorlens.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="run-")
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=f"{scratch}/warehouse",
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", f"{scratch}/checkpoints")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def when(text):
    return None if text is None else dt.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def donations(spark):
    """Build donations from (customer_id, time, price, status, is_campaign, is_recurrent); later fields may be left out."""

    def build(*rows):
        from decimal import Decimal

        full = []
        for i, row in enumerate(rows, 1):
            customer, ts, price, status, campaign, recurrent = (*row, *(None, 100, "Paid", False, False)[len(row) - 1 :])
            money = None if price is None else Decimal(str(price))
            full.append((i, i, customer, when(ts), money, status, campaign, recurrent))
        return spark.createDataFrame(full, DONATIONS)

    return build


@pytest.fixture(scope="session")
def actions(spark):
    """Build actions from (customer_id, time, channel, source); later fields may be left out."""

    def build(*rows):
        full = []
        for row in rows:
            customer, ts, channel, source = (*row, *(None, "site", None)[len(row) - 1 :])
            full.append((customer, when(ts), channel, source))
        return spark.createDataFrame(full, ACTIONS)

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]
