"""Joins that a key with a third of all rows doesn't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows counts as hot; there are fewer such keys than this.
HOT_SHARES = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows` with the columns of `facts`, which has one row for each `key` and in `size` the number of its rows, of
    `total` in all. Hot keys, at most HOT_SHARES of them, are broadcast; their rows are spread and take no part in the
    shuffle join. The key is a string that is never null; facts that a row doesn't find are null."""
    columns = [c for c in facts.columns if c != key]
    is_hot = F.col(size) * HOT_SHARES > total
    hot = facts.where(is_hot).select(F.col(key).alias("_hot"), F.struct(*columns).alias("_of_hot"))
    cold = facts.where(~is_hot).select(F.col(key).alias("_cold"), F.struct(*columns).alias("_of_cold"))
    found = F.col("_hot").isNotNull()
    spread = F.concat(F.lit("\x00"), F.xxhash64(*rows.columns).cast("string"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    marked = marked.withColumn("_join", F.when(found, spread).otherwise(F.col(key)))
    joined = marked.join(cold, F.col("_join") == F.col("_cold"), "left")
    of = F.when(found, F.col("_of_hot")).otherwise(F.col("_of_cold"))
    return joined.select(*rows.columns, *(of[c].alias(c) for c in columns))
