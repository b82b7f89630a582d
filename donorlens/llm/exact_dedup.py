"""Exact deduplication by skew-safe combining.

Copies are combined three times, each time by digest and full content: inside each input partition (the map side of
the first aggregation), then in salted digest groups, then across the salts of a digest. A group that holds a third of
all rows sends one row per input partition, spread over the salts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.skew import attach
from donorlens.llm.store import shuffle_partitions, written


def folded(text: Column) -> Column:
    """Null as empty, A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest=None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays.
    A null id is smaller than any other; if a group has null ids only, keep_id is null and one of its rows is kept.
    Of rows that repeat both the largest id and the text, exactly one is kept. An empty table gives an empty result.
    Columns other than the two named ones are not read. `digest`, SHA-256 unless given, may collide: contents decide.
    """
    salts = salts or shuffle_partitions(df.sparkSession)
    rows = df.select(df[id_col].alias("doc_id"), folded(df[text_col]).alias("content"))
    rows = rows.withColumn("text_sha256", F.sha2("content", 256))
    rows = rows.withColumn("digest", digest(F.col("content")) if digest else F.col("text_sha256"))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "content")
        .agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    )
    # Dealt by digest alone, so that the contents of one digest meet without another shuffle.
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    classes = written(
        winners.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
        ),
        "exact-classes",
    )
    total, most = classes.agg(F.sum("group_size"), F.max("contents")).first()
    if (most or 0) > 1:
        # Different contents share a digest, so the content has to go along as part of the key.
        joined = rows.join(winners, ["digest", "content"])
    else:
        joined = attach(rows.drop("content"), classes.drop("contents"), "digest", "group_size", total or 0)
    copy = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (copy == 1)
    return joined.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")

