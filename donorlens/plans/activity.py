"""Daily, weekly and monthly active donors and stickiness.

A donor's activity in a year or month is a bit map: a bit for each day, week and month of it. Maps merge by OR, so the raw
rows of a donor, however many, come down to one row of a few numbers per task before the only shuffle of donors; days, weeks
and months are all counted from it. OR over the donors gives the days, weeks and months that had any donor at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.functions import periods
from donorlens.functions.numbers import ratio
from donorlens.operators.pivots import with_total

KINDS = ("day", "week", "month")
#: Bits of a number that are used.
WORD = 63
#: Days of the longest period of each unit.
DAYS = {"year": 366, "month": 31}


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _bit_maps(donations: DataFrame, unit: str) -> DataFrame:
    """(customer_id, _period, day0, day1..., week, month): the days, weeks and months of the period with a donation.

    A row without a date belongs to the null period, which is one day of one week of one month.
    """
    day = F.col("day")
    start = F.trunc(day, unit)
    place = F.coalesce(F.datediff(day, start), F.lit(0))
    week = F.floor(F.datediff(day, F.trunc(start, "week")) / 7).cast("int")
    days = [
        F.bit_or(F.when(place.between(i * WORD, (i + 1) * WORD - 1), _bit(place - i * WORD))).alias(f"day{i}")
        for i in range(-(-DAYS[unit] // WORD))
    ]
    weeks = F.bit_or(_bit(F.coalesce(week, F.lit(0)))).alias("week")
    months = F.bit_or(_bit(F.coalesce(F.month(day) - F.month(start), F.lit(0)))).alias("month")
    dated = donations.select("customer_id", periods.day("order_ts").alias("day"))
    return dated.groupBy("customer_id", start.alias("_period")).agg(*days, weeks, months)


def _totals(donations: DataFrame, unit: str) -> DataFrame:
    """Per period (``year`` or ``month``): number of active days, weeks and months and the sum of their distinct users."""
    maps = _bit_maps(donations, unit)
    numbers = {kind: [c for c in maps.columns if c.rstrip("0123456789") == kind] for kind in KINDS}
    known = F.col("customer_id").isNotNull()

    def bits(columns: list[Column]) -> Column:
        return sum((F.coalesce(F.bit_count(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.bit_count(columns[0]), F.lit(0)))

    return maps.groupBy("_period").agg(
        *[
            F.sum(F.when(known, bits([F.col(c) for c in columns])).otherwise(0)).alias(f"{kind}_users")
            for kind, columns in numbers.items()
        ],
        *[bits([F.bit_or(c) for c in columns]).cast("long").alias(f"{kind}_spans") for kind, columns in numbers.items()],
    )


def _rates(totals: DataFrame, label: Column) -> DataFrame:
    dau, wau, mau = (
        F.when(label.isNotNull(), ratio(F.col(f"{kind}_users"), F.col(f"{kind}_spans"))) for kind in KINDS
    )
    return totals.select(
        label,
        F.round(dau, 2).alias("avg_dau"),
        F.round(wau, 2).alias("avg_wau"),
        F.round(mau, 2).alias("avg_mau"),
        F.round(F.try_divide(dau, mau) * 100, 2).alias("sticky_factor_mau"),
        F.round(F.try_divide(dau, wau) * 100, 2).alias("sticky_factor_wau"),
    )


def activity_by_year(donations: DataFrame) -> DataFrame:
    """Averages per year, and over all days, weeks and months in the ``Total`` row.

    Periods without donations do not count; a week that crosses New Year is two weeks. A null timestamp gives a row
    of nulls, but its users count in ``Total``.
    """
    by_year = _totals(donations, "year")
    measures = [c for c in by_year.columns if c != "_period"]
    return _rates(with_total(by_year, periods.year_label(F.year("_period")), "year", measures), F.col("year")).orderBy("year")


def activity_by_month(donations: DataFrame) -> DataFrame:
    """Averages per month; a week that crosses a month's end counts in both months."""
    by_month = _totals(donations, "month")
    return _rates(by_month, periods.month_label("_period").alias("month")).orderBy("month")
