"""Wide tables with an explicit column list, so the schema is fixed and no job runs to find the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_pivot(df: DataFrame, row: str, period: str, periods: Sequence[int], value: str, total: bool = False) -> DataFrame:
    """Sum of ``value`` per row and period, 0 where there is none; rows outside all periods stay as zeros."""
    cell = [F.sum(F.when(F.col(period) == p, F.col(value)).otherwise(0)).cast("bigint").alias(str(p)) for p in periods]
    if total:
        listed = F.col(period).isin(list(periods))
        cell.append(F.sum(F.when(listed, F.col(value)).otherwise(0)).cast("bigint").alias("total"))
    return df.groupBy(row).agg(*cell)


def matrix_pivot(df: DataFrame, rows: Sequence[str], period: str, periods: Sequence[str], value: str) -> DataFrame:
    """One cell per row and period, null where there is none."""
    return df.groupBy(*rows).pivot(period, list(periods)).agg(F.max(value))


def with_total(df: DataFrame, label: Column, name: str, sums: Sequence[str]) -> DataFrame:
    """Sum ``sums`` per ``label`` and once more over all rows, labelled ``Total``. For tables that are small already."""
    labels = F.explode(F.array(label, F.lit("Total"))).alias(name)
    return df.select(labels, *sums).groupBy(name).agg(*[F.sum(c).alias(c) for c in sums])


def newest_first(df: DataFrame, fixed: int = 2) -> DataFrame:
    """Keep the first ``fixed`` columns and reverse the others."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:fixed] + df.columns[fixed:][::-1]])
