"""Calendar periods.

Rows are grouped on compact keys (an int year, a DATE) and turned into text labels only after aggregation, so no
formatter runs per input row.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def day(ts: str | Column) -> Column:
    return F.to_date(ts)


def month(ts: str | Column) -> Column:
    """First day of the month."""
    return F.trunc(F.to_date(ts), "month")


def year(ts: str | Column) -> Column:
    return F.year(ts)


def year_label(year_number: str | Column) -> Column:
    return F.lpad(_col(year_number).cast("string"), 4, "0")


def month_label(month_start: str | Column) -> Column:
    return F.date_format(_col(month_start), "yyyy-MM")


def days_between(start: str | Column, end: str | Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(MICROS_PER_DAY)


def moment(at: dt.datetime) -> Column:
    """A wall-clock time as a literal. The text form keeps the driver's time zone out of it."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def in_years(ts: str, years: Sequence[int]) -> Column:
    """Rows whose timestamp falls in one of ``years``, as ranges the parquet scan can prune on."""

    first_of = [(moment(dt.datetime(a, 1, 1)), moment(dt.datetime(b + 1, 1, 1))) for a, b in _runs(years)]
    spans = [(F.col(ts) >= begin) & (F.col(ts) < end) for begin, end in first_of]
    return reduce(operator.or_, spans) if spans else F.lit(False)


def _runs(years: Sequence[int]) -> list[tuple[int, int]]:
    """First and last year of each unbroken run."""
    runs: list[tuple[int, int]] = []
    for y in sorted(set(years)):
        if runs and runs[-1][1] == y - 1:
            runs[-1] = (runs[-1][0], y)
        else:
            runs.append((y, y))
    return runs


class Spine:
    """A contiguous run of months: ``Spine("2021-01", 45)``."""

    def __init__(self, start: str, n_months: int):
        y, m = (int(part) for part in start.split("-"))
        self.months = [dt.date(y + (m - 1 + n) // 12, (m - 1 + n) % 12 + 1, 1) for n in range(n_months)]

    @property
    def labels(self) -> list[str]:
        return [m.strftime("%Y-%m") for m in self.months]

    def contains(self, month_start: str) -> Column:
        return F.col(month_start).between(F.lit(self.months[0]), F.lit(self.months[-1]))

    def frame(self, like: DataFrame, name: str = "month") -> DataFrame:
        """One row per month of the spine."""
        months = F.sequence(F.lit(self.months[0]), F.lit(self.months[-1]), F.expr("interval 1 month"))
        return like.sparkSession.range(1, numPartitions=1).select(F.explode(months).alias(name))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
