"""Ranks, running sums and neighbours in one order over a whole table, without a task that sees all of it.

Rows are dealt by ranges of the order, so that a key with a third of the rows spans as many ranges as its rows fill. Inside a
range, windows give local answers. What a range needs from those before it is one row for each range (how many rows, their
sums, the last row): these few rows are added up and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from donorlens.sources.scratch import written

PART = "_part"


class Ordered:
    """A table in an order of columns.

    ``order``: column names, or ``("name", "desc")``; nulls come first, or last where descending. It should tell all rows
    apart: rows that are equal in it come in any order and lie in one range. ``n`` is the number of ranges, the session's
    shuffle partitions unless given. The rows are written once, so that every result refers to the same ranges.
    """

    def __init__(self, df: DataFrame, *order: str | tuple[str, str], n: int | None = None):
        self.names = [o if isinstance(o, str) else o[0] for o in order]
        self.sorting = [F.asc(o) if isinstance(o, str) else F.desc(o[0]) for o in order]
        self.columns = df.columns
        n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = df.repartitionByRange(n, *self.sorting).withColumn(PART, F.spark_partition_id())
        self.rows = written(ranges, "ordered")

    def _local(self) -> WindowSpec:
        return Window.partitionBy(PART).orderBy(*self.sorting)

    def _before(self, rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
        """For each range the sums over the ranges before it. One row a range."""
        parts = rows.groupBy(PART).agg(*[total.alias(name) for name, total in totals.items()])
        earlier = Window.partitionBy().orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        return parts.select(PART, *[F.sum(name).over(earlier).alias(name) for name in totals])

    def _with(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Facts about ranges are as many as the ranges, a parameter."""
        return rows.join(F.broadcast(facts), PART)

    def running(self, **sums: str | Column) -> DataFrame:
        """The rows with ``row_number`` and, under each name, the sum up to and including the row. Sums of DECIMAL are exact;
        nulls add nothing, and before any value the sum is null."""
        values = {f"_v_{name}": F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
        rows = self.rows.withColumns(values) if values else self.rows
        before = self._before(rows, {"_rows": F.count(F.lit(1)), **{f"_t_{name}": F.sum(f"_v_{name}") for name in sums}})
        to_here = self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = rows.withColumns(
            {"_nr": F.row_number().over(self._local()), **{f"_l_{name}": F.sum(f"_v_{name}").over(to_here) for name in sums}}
        )
        found = self._with(local, before)

        def total(name: str) -> Column:
            carried, own = F.col(f"_t_{name}"), F.col(f"_l_{name}")
            return F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0)))

        return found.select(
            *self.columns,
            (F.coalesce("_rows", F.lit(0)) + F.col("_nr")).alias("row_number"),
            *[total(name).alias(name) for name in sums],
        )

    def ranked(self, *by: str) -> DataFrame:
        """The rows with ``row_number`` and ``rank``. Rows that are equal in ``by``, the first columns of the order, share the
        rank of the first of them, also across ranges."""
        if list(by) != self.names[: len(by)] or not by:
            raise ValueError(f"a rank needs the first columns of the order, {self.names}")
        key, counts = F.struct(*by), self._before(self.rows, {"_rows": F.count(F.lit(1))})
        ties = Window.partitionBy(PART).orderBy(*self.sorting[: len(by)])
        local = self.rows.withColumn("_nr", F.row_number().over(self._local())).withColumn("_rank", F.rank().over(ties))
        local = self._with(local, counts).withColumn("_rows", F.coalesce("_rows", F.lit(0)))
        local = local.withColumn("row_number", F.col("_rows") + F.col("_nr")).withColumn("_first", F.col("_rows") + F.col("_rank"))
        # The value that a range ends with, and where it began; if the range has no other value, it may have begun before.
        tops = local.groupBy(PART).agg(
            F.min_by(key, "row_number").alias("_low"), F.max_by(key, "row_number").alias("_high"), F.max_by("_first", "row_number").alias("_begin")
        )
        in_order = Window.partitionBy().orderBy(PART)
        previous = F.lag("_high").over(in_order)
        goes_on = F.col("_low").eqNullSafe(previous) & F.lag(PART).over(in_order).isNotNull()
        whole = goes_on & F.col("_low").eqNullSafe(F.col("_high"))
        tops = tops.select(PART, previous.alias("_carried"), goes_on.alias("_goes_on"), F.when(~whole, F.col("_begin")).alias("_begin"))
        earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.select(PART, "_carried", "_goes_on", F.last("_begin", ignorenulls=True).over(earlier).alias("_since"))
        found = self._with(local, carried)
        rank = F.when(F.col("_goes_on") & key.eqNullSafe(F.col("_carried")), F.col("_since")).otherwise(F.col("_first"))
        return found.select(*self.columns, "row_number", rank.alias("rank"))

    def neighbours(self, within: Sequence[str], previous: dict[str, str] | None = None, following: dict[str, str] | None = None) -> DataFrame:
        """The rows with columns of the row before (``previous``: name -> column) and behind (``following``) in the order, null
        where that row differs in ``within``, the first columns of the order. Null keys are one key."""
        if list(within) != self.names[: len(within)]:
            raise ValueError(f"neighbours lie within the first columns of the order, {self.names}")
        previous, following = previous or {}, following or {}
        needed = list(dict.fromkeys([*within, *previous.values(), *following.values()]))
        row = F.struct(*needed)
        rows = self.rows.withColumn("_nr", F.row_number().over(self._local()))
        edges = rows.groupBy(PART).agg(F.min_by(row, "_nr").alias("_first"), F.max_by(row, "_nr").alias("_last"))
        in_order = Window.partitionBy().orderBy(PART)
        edges = edges.select(PART, F.lag("_last").over(in_order).alias("_edge_before"), F.lead("_first").over(in_order).alias("_edge_behind"))
        local = rows.withColumn("_before", F.lag(row).over(self._local())).withColumn("_behind", F.lead(row).over(self._local()))
        found = self._with(local, edges)
        before, behind = F.coalesce("_before", "_edge_before"), F.coalesce("_behind", "_edge_behind")

        def same(other: Column) -> Column:
            equal = F.lit(True)
            for name in within:
                equal = equal & other[name].eqNullSafe(F.col(name))
            return other.isNotNull() & equal

        return found.select(
            *self.columns,
            *[F.when(same(before), before[c]).alias(name) for name, c in previous.items()],
            *[F.when(same(behind), behind[c]).alias(name) for name, c in following.items()],
        )
