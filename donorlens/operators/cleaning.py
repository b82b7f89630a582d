"""Cleaning of raw exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# A plain or scientific decimal number. Texts are matched first because every failed cast costs an exception.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


EXACT = "decimal(38,15)"


def number(c: Column, dtype: str = "string") -> Column:
    """A number or its text as a decimal; null if it is not a number or too large."""
    return (F.when(c.rlike(NUMBER), c.try_cast(EXACT)) if dtype == "string" else c).try_cast(EXACT)


def whole_number(c: Column, dtype: str = "string") -> Column:
    """A number or its text as BIGINT, fraction cut off; null if it is not a number or too large."""
    return (number(c) if dtype == "string" else c).try_cast("bigint")


def drop_columns(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop columns; absent ones are ignored, or an error if ``strict``."""
    absent = [c for c in columns if c not in df.columns]
    if strict and absent:
        raise KeyError(f"columns not found: {absent}")
    return df.drop(*columns)


def drop_empty_columns(df: DataFrame, counts: Mapping[str, int] | None = None) -> DataFrame:
    """Drop columns without any value; no rows at all drops every column. Runs one aggregation that returns one row, unless the
    ``counts`` of values are known."""
    if not df.columns:
        return df
    if counts is None:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def differs_from_copy(df: DataFrame, column: str, candidate: str) -> Column:
    """Whether ``candidate`` has a value whose whole number differs from ``column`` as it is."""
    dtypes = dict(df.dtypes)
    differs = ~number(F.col(column), dtypes[column]).eqNullSafe(whole_number(F.col(candidate), dtypes[candidate]).cast(EXACT))
    return F.col(candidate).isNotNull() & differs


def duplicate_check(df: DataFrame, column: str, candidate: str) -> DataFrame:
    """One row: over rows where ``candidate`` has a value, in how many its whole number differs from ``column`` as it is."""
    return df.where(F.col(candidate).isNotNull()).agg(
        F.count("*").alias("compared"), F.count_if(differs_from_copy(df, column, candidate)).alias("different")
    )


def drop_if_duplicate(df: DataFrame, column: str, candidate: str, different: int | None = None) -> DataFrame:
    """Drop ``candidate`` if it repeats ``column`` wherever it has a value; ``different``, if known, are the rows where not."""
    if different is None:
        different = duplicate_check(df, column, candidate).first()["different"]
    return df.drop(candidate) if different == 0 else df


def lost_values(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The share of each column's values that ``after`` has as null. Two aggregations of one row each."""
    if not columns:
        return {}
    had, has = (df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first() for df in (before, after))
    return {c: (had[c] - has[c]) / had[c] if had[c] else 0.0 for c in columns}


def to_timestamps(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Text to timestamps, in the format ``fmt`` if given; what cannot be parsed becomes null."""

    return df.withColumns({c: moment_of(c, fmt) for c in columns})


def moment_of(column: str, fmt: str | None = None) -> Column:
    """A text column as a timestamp, null where it is none."""
    if fmt is None:
        return F.col(column).try_cast("timestamp_ntz")
    return F.try_to_timestamp(F.col(column), F.lit(fmt)).cast("timestamp_ntz")


def to_integers(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Columns as whole numbers; what cannot be parsed becomes null, or an error if ``strict``."""
    dtypes = dict(df.dtypes)

    def parsed(c: str) -> Column:
        whole = whole_number(F.col(c), dtypes[c])
        return F.coalesce(whole, F.raise_error(F.lit(f"{c}: value is not a number"))) if strict else whole

    return df.withColumns({c: parsed(c) for c in columns})
