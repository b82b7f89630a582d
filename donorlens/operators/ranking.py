"""Top-k, bottom-k and shares over aggregated tables. Ties are always broken by the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    ranked = Window.partitionBy(group).orderBy(F.desc(value), F.asc_nulls_first(tie))
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k).drop("_rank")


def top_bottom_limit(df: DataFrame, value: str, key: str, k: int, label: str = "category") -> DataFrame:
    """The k highest rows labelled ``top`` and the k lowest labelled ``bottom``; with fewer than 2k rows some are in both."""
    top = df.orderBy(F.desc_nulls_last(value), F.asc_nulls_first(key)).limit(k).withColumn(label, F.lit("top"))
    bottom = df.orderBy(F.asc_nulls_first(value), F.asc_nulls_first(key)).limit(k).withColumn(label, F.lit("bottom"))
    return top.unionByName(bottom)


def top_bottom_rank(df: DataFrame, value: str, key: str, k: int, label: str = "category") -> DataFrame:
    """The k highest rows labelled ``top`` and the k lowest labelled ``bottom``, each row once, ``top`` first.

    Each end comes from sorted limits, of which a task keeps 2k rows at most; only those 2k lowest rows are numbered in one
    partition, to leave out what is on top already.
    """
    low_first = [F.asc_nulls_first(value), F.desc_nulls_last(key)]
    top = df.orderBy(F.desc_nulls_last(value), F.asc_nulls_first(key)).limit(k).withColumn(label, F.lit("top"))
    whole = Window.partitionBy()
    lowest = df.orderBy(*low_first).limit(2 * k)
    lowest = lowest.withColumn("_rank", F.row_number().over(whole.orderBy(*low_first))).withColumn("_size", F.count("*").over(whole))
    bottom = lowest.where((F.col("_rank") <= k) & (F.col("_rank") <= F.col("_size") - k))
    return top.unionByName(bottom.withColumn(label, F.lit("bottom")).drop("_rank", "_size"))
