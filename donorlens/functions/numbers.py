"""Money and ratios. Money is summed as DECIMAL (order-independent) and leaves as DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Real division; null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(c: str | Column) -> Column:
    """Mean of the non-null values from an exact sum, so the result does not depend on row order."""
    return ratio(F.sum(c), F.count(c))


def money_mean(total: Column, n: Column) -> Column:
    """``total / n`` rounded half up to two digits; divided as DECIMAL, so exact halves round as written."""
    return F.round(F.try_divide(total.cast("decimal(30,2)"), n.cast("decimal(20,0)")), 2).cast("double")


def money(c: Column) -> Column:
    return c.cast("double")


def when_status(status: str, value: Column, otherwise: object = None) -> Column:
    return F.when(F.col("status") == status, value).otherwise(otherwise)
