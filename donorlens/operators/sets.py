"""Set membership between tables.

Row tables are first reduced to one row per key with a row count. The reduction combines on the map side, so a key
that owns a large part of all rows reaches the join as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """(key, n_rows), the null key included."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows"))


def keys(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Distinct non-null keys."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def not_in(left: DataFrame, right: DataFrame, key: str = "customer_id", ignore_null_ids: bool = False) -> DataFrame:
    """Rows of ``left`` whose key is NOT IN ``right``'s keys, with SQL's three-valued logic.

    One null key in ``right`` empties the result; an empty ``right`` keeps everything, null keys of ``left`` too.
    Spark's own null-aware anti join must broadcast ``right``; this one shuffles both sides, and only a one-row
    summary of ``right`` (row count, null count) is broadcast. ``ignore_null_ids`` drops nulls on both sides first.
    """
    unmatched = left.join(keys(right, key), key, "left_anti")
    if ignore_null_ids:
        return unmatched.where(F.col(key).isNotNull())
    summary = right.agg(
        F.count("*").alias("_n_right"), F.count_if(F.col(key).isNull()).alias("_n_right_null")
    )
    kept = (F.col("_n_right") == 0) | ((F.col("_n_right_null") == 0) & F.col(key).isNotNull())
    return unmatched.crossJoin(F.broadcast(summary)).where(kept).drop("_n_right", "_n_right_null")


def repeat_rows(counts: DataFrame, key: str = "customer_id", chunk: int = 100_000) -> DataFrame:
    """Undo ``key_counts``: every key as many times as it was counted.

    Counts are cut into chunks that are spread over the cluster before they are unfolded, so a key with a huge count
    is written by many tasks.
    """
    last_chunk = F.floor((F.col("n_rows") - 1) / chunk).cast("bigint")
    chunks = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    size = F.least(F.lit(chunk), F.col("n_rows") - F.col("_chunk") * chunk).cast("int")
    return chunks.repartition(key, "_chunk").select(F.explode(F.array_repeat(F.col(key), size)).alias(key))
