"""Counts gathered while a table is written, so that no report reads it again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from donorlens.operators import profiling
from donorlens.operators.cleaning import differs_from_copy


@dataclass(frozen=True)
class Counts:
    """``non_null``: values of each column as it was written; ``readable``: values of the columns that are to be converted of
    which the conversion makes something; ``different``: by (column, copy) the rows whose copy says something else."""

    rows: int
    non_null: dict[str, int]
    readable: dict[str, int]
    different: dict[tuple[str, str], int]

    def lost(self) -> dict[str, float]:
        """The share of each column's values that its conversion loses."""
        return {c: (self.non_null[c] - n) / self.non_null[c] if self.non_null[c] else 0.0 for c, n in self.readable.items()}

    def profile(self, like: DataFrame) -> DataFrame:
        """``profiling.dataset_profile`` of the converted table ``like``, from the counts alone."""
        found = [(c, t, n, self.rows - n) for c, t in like.dtypes for n in [self.readable.get(c, self.non_null[c])]]
        rows = like.sparkSession.createDataFrame(found, "column string, dtype string, non_null bigint, missing bigint")
        return rows.orderBy("missing", "column")

    def null_rates(self, like: DataFrame) -> DataFrame:
        return profiling.rates_of(self.profile(like))

    def row_delta(self, like: DataFrame, name: str) -> DataFrame:
        """Conversions keep all rows."""
        both = like.sparkSession.createDataFrame([(self.rows, self.rows)], "rows_before bigint, rows_after bigint")
        return profiling.delta_of(both, name)


def observed(
    df: DataFrame, converted: Mapping[str, Column] | None = None, copies: Sequence[tuple[str, str]] = ()
) -> tuple[DataFrame, "Pending"]:
    """``df`` with counts on its way: once an action has run over all its rows, ``Pending.counts()`` has them.

    ``converted``: what a column is to become; ``copies``: pairs of columns of which the second may repeat the first. The
    counts are sums that tasks send along with their results, a row in all.
    """
    converted = {c: e for c, e in (converted or {}).items() if c in df.columns}
    copies = [pair for pair in copies if set(pair) <= set(df.columns)]
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count(F.col(f"`{c}`")).alias(f"non_null_{i}") for i, c in enumerate(df.columns)]
    metrics += [F.count(e).alias(f"readable_{i}") for i, e in enumerate(converted.values())]
    metrics += [F.count_if(differs_from_copy(df, *pair)).alias(f"different_{i}") for i, pair in enumerate(copies)]
    observation = Observation()
    return df.observe(observation, *metrics), Pending(observation, df.columns, list(converted), copies)


@dataclass(frozen=True)
class Pending:
    observation: Observation
    columns: list[str]
    converted: list[str]
    copies: list[tuple[str, str]]

    def counts(self) -> Counts:
        """Waits for the first action over the observed rows."""
        found = self.observation.get
        return Counts(
            found["rows"],
            {c: found[f"non_null_{i}"] for i, c in enumerate(self.columns)},
            {c: found[f"readable_{i}"] for i, c in enumerate(self.converted)},
            {pair: found[f"different_{i}"] for i, pair in enumerate(self.copies)},
        )


def written(
    df: DataFrame, path: str, converted: Mapping[str, Column] | None = None, copies: Sequence[tuple[str, str]] = ()
) -> tuple[DataFrame, Counts]:
    """Write the rows as Parquet, counting on the way; gives what was written and the counts."""
    counted, pending = observed(df, converted, copies)
    counted.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), pending.counts()
