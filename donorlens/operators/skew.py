"""Keys that own a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The smallest share that counts as hot: fewer than a million keys are broadcast.
MIN_SHARE = 1e-6


def hot_keys(df: DataFrame, key: str, share: float, **facts: Column) -> DataFrame:
    """(key, facts...) for keys with more than ``share`` of the rows, to be broadcast.

    Whatever the data, there are fewer than ``1 / share`` of them. ``facts`` are aggregates over the key's rows; they
    combine on the map side, so a hot key costs no more than any other. ``share`` has to leave the broadcast small.
    """
    if not MIN_SHARE <= share <= 1:
        raise ValueError(f"share must be at least {MIN_SHARE} and at most 1")
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"), *[fact.alias(name) for name, fact in facts.items()])
    total = per_key.agg(F.sum("_n").alias("_total"))
    hot = per_key.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_total") * F.lit(share))
    return F.broadcast(hot.drop("_n", "_total"))
