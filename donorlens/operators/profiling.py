"""Profiles and reports, returned as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.functions.numbers import ratio


def removed_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in before.columns if c not in after.columns]


def changed_types(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns present in both whose type differs."""
    types = {f.name: f.dataType for f in after.schema.fields}
    return [f.name for f in before.schema.fields if f.name in types and types[f.name] != f.dataType]


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, change, type_before, type_after, n_values): columns that were ``removed`` or ``retyped`` and the values that
    ``before`` has in them. One pass over the data."""
    types, changed = dict(after.dtypes), changed_types(before, after)
    kinds = {c: "removed" for c in removed_columns(before, after)} | {c: "retyped" for c in changed}
    found = dataset_profile(before.select(*[F.col(f"`{c}`") for c in kinds]))
    by_name = F.create_map(*[x for c, kind in kinds.items() for x in (F.lit(c), F.struct(F.lit(kind), F.lit(types.get(c)).cast('string')))])
    of = by_name[F.col("column")] if kinds else F.struct(F.lit(None).cast("string"), F.lit(None).cast("string"))
    named = found.withColumn("_of", of.cast("struct<change: string, type_after: string>"))
    return named.select("column", "_of.change", F.col("dtype").alias("type_before"), "_of.type_after", F.col("non_null").alias("n_values"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, missing), fewest missing first. One pass over the data."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, dtype string, non_null bigint, missing bigint")
    counted = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    described = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"), F.lit(dtype).alias("dtype"), F.col(f"c{i}").alias("non_null"),
                (F.col("n") - F.col(f"c{i}")).alias("missing"),
            )
            for i, (name, dtype) in enumerate(df.dtypes)
        ]
    )
    return counted.select(F.inline(described)).orderBy("missing", "column")


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_pct) with percentages rounded to five digits, lowest first."""
    return rates_of(dataset_profile(df))


def rates_of(profile: DataFrame) -> DataFrame:
    """``null_rates`` from a profile that is there already."""
    pct = ratio(F.col("missing"), F.col("missing") + F.col("non_null")) * 100
    return profile.select("column", F.round(pct, 5).alias("null_pct")).orderBy("null_pct", "column")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values by frequency, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), column)


def row_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """MD5 of the seed and of the columns as text, null and empty told apart."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("|="), F.col(f"`{c}`").cast("string")), F.lit("|")) for c in columns]))


def random_rows(df: DataFrame, columns: Sequence[str], n: int = 5, seed: int | None = None) -> DataFrame:
    """``n`` random rows of the given columns.

    With a seed they are the ``n`` rows of the least hashes: the same however the table is partitioned. Each task keeps
    ``n`` rows at most, and so does each merge. Rows that are equal in the columns come together.
    """
    rows = df.select(*columns)
    if seed is None:
        return rows.orderBy(F.rand()).limit(n)
    return rows.orderBy(row_hash(columns, seed), *columns).limit(n)


def random_rows_by(df: DataFrame, group: str, columns: Sequence[str], n: int = 5, seed: int = 0) -> DataFrame:
    """The ``n`` rows of the least hashes of each value of ``group``, which comes first. Each task keeps ``n`` rows of a group."""
    least = Window.partitionBy(group).orderBy("_hash", *columns)
    hashed = df.select(group, *columns).withColumn("_hash", row_hash(columns, seed))
    return hashed.withColumn("_nr", F.row_number().over(least)).where(F.col("_nr") <= n).drop("_hash", "_nr")


def row_delta(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(dataset, rows_before, rows_after, deleted_pct); the percentage is null for an empty ``before``."""
    counts = before.agg(F.count("*").alias("rows_before")).crossJoin(
        F.broadcast(after.agg(F.count("*").alias("rows_after")))
    )
    return delta_of(counts, name)


def delta_of(counts: DataFrame, name: str) -> DataFrame:
    """``row_delta`` from one row of (rows_before, rows_after)."""
    deleted = ratio(F.col("rows_before") - F.col("rows_after"), F.col("rows_before")) * 100
    return counts.select(
        F.lit(name).alias("dataset"), "rows_before", "rows_after", F.round(deleted, 2).alias("deleted_pct")
    )
