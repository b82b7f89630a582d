"""K-d tree partitioning: split at weighted medians along the widest metadata dimension until leaves reach their size.

The tree has few nodes and lives on the driver; the rows stay in Spark. A median is found by counting bytes in a fixed
number of bins, again inside the bin that holds it, and so on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.skew import attach
from donorlens.llm.store import written
from donorlens.operators.ordered import Ordered

BINS = 2048
#: A cut is near enough when the bin that holds it has less than one in so many of the node's bytes.
PRECISION = 4000
#: Rows whose slots one task numbers.
BUCKET_ROWS = 50_000
TIE_TOP = (1 << 63) - 1


@dataclass
class Node:
    """A leaf to be: `count` shards from number `first` on. A cut leaves what is below (dimension value, tie) on the left."""

    first: int
    count: int
    cut: tuple[str, int, int] | None = None
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [leaf for child in self.children for leaf in child.leaves()] if self.children else [self]

    def assign(self) -> Column:
        """The first shard of the leaf that a row belongs to."""
        if not self.children:
            return F.lit(self.first)
        dim, value, tie = self.cut
        left = (F.col(dim) < value) | ((F.col(dim) == value) & (F.col("tie") < tie))
        return F.when(left, self.children[0].assign()).otherwise(self.children[1].assign())


def _with_places(rows: DataFrame, column: str, total: int) -> DataFrame:
    """`rows` with the text in `column` replaced by its place among the distinct texts in their order; null is place 0.

    The distinct texts are put in order by ranges, and a text that many rows have is broadcast to them (at most HOT_SHARES)."""
    counts = written(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "kd-texts")
    places = Ordered(counts, column).running().select(column, "n", F.col("row_number").alias("place"))
    others = [c for c in rows.columns if c != column]
    # Nulls join nothing; they are spread by their hash.
    key = F.coalesce(F.concat(F.lit("="), F.col(column)), F.concat(F.lit("-"), F.col("hash").cast("string")))
    facts = places.select(F.concat(F.lit("="), F.col(column)).alias("_text"), "n", "place")
    found = attach(rows.withColumn("_text", key), facts, "_text", "n", total)
    return found.select(*others, F.coalesce("place", F.lit(0)).cast("long").alias(column))


def kd_shards(
    df: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("n_chars", "lang", "source"),
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the UTF-8 bytes of the text plus 1; null counts as empty. Shards are as near in bytes as the largest rows at
    the cuts allow (law `bytes`); `slot` numbers a shard's rows from 0; `grown_shard` is null. The number of shards is
    given, or the bytes divided by `target_bytes`. Equal texts (by CRC-32 and 64-bit hash) share the least of their metadata
    and stay in one shard, unless they alone are more than a shard's part of all bytes; then ids divide them. Texts of
    metadata count by their place among the distinct ones in order, nulls come first; a dimension that the table lacks is left
    out. Rows that repeat an id and a text go to one shard. An empty table gives an empty result; shards may
    stay empty where there are fewer rows than shards.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    names = [d for d in dims if d in df.columns]
    texts = [f"dim_{i}" for i, d in enumerate(names) if df.schema[d].dataType.typeName() == "string"]
    coordinates = [df[d] if f"dim_{i}" in texts else F.coalesce(df[d].cast("long"), F.lit(-1)) for i, d in enumerate(names)]
    columns = [f"dim_{i}" for i in range(len(names))] or ["tie"]
    crc = F.crc32(text.cast("binary"))
    rows = written(
        df.select(
            df[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            crc.alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            *(c.alias(f"dim_{i}") for i, c in enumerate(coordinates)),
        ).withColumn("content", F.concat_ws(":", "text_crc32", "hash")),
        "kd-rows",
    )
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    for column in texts:
        rows = _with_places(rows, column, n_rows)
    rows = written(rows, "kd-placed") if texts else rows
    shards = shards or max(1, -(-total // target_bytes))
    least = [F.min(f"dim_{i}").alias(f"dim_{i}") for i in range(len(names))]
    groups = rows.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("weight"), *least)
    own = rows.select("doc_id", "size", "text_crc32", "hash", "content")
    divided = F.col("weight").cast("decimal(38,0)") * shards > total
    low = F.when(divided, F.xxhash64("doc_id")).otherwise(F.col("hash")).bitwiseAND(F.lit(0x7FFFFFFF))
    tie = F.shiftleft("text_crc32", 31).bitwiseOR(low)
    placed = attach(own, written(groups, "kd-groups"), "content", "copies", n_rows)
    dimensions = [f"dim_{i}" for i in range(len(names))]
    points = written(placed.select("doc_id", "size", "text_crc32", tie.alias("tie"), *dimensions), "kd-points")
    root = Node(0, shards)
    extent = None
    while total and any(leaf.count > 1 for leaf in root.leaves()):
        extent = _split_level(points, root, columns, extent)
    return _numbered(points.withColumn("shard", root.assign().cast("int")))


def _split_level(points: DataFrame, root: Node, columns: list[str], extent: dict | None) -> dict:
    """Cut each leaf that is to become several shards. Returns the root's extent in each dimension."""
    rows = points.withColumn("node", root.assign())
    stats = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]
    found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *stats).collect()}
    extent = extent or {c: max(1, found[0][f"high_{c}"] - found[0][f"low_{c}"]) for c in columns}
    cuts = {}
    for leaf in root.leaves():
        if leaf.count == 1:
            continue
        leaf.children = [Node(leaf.first, leaf.count // 2), Node(leaf.first + leaf.count // 2, leaf.count - leaf.count // 2)]
        if leaf.first not in found:
            leaf.cut = (columns[0], 0, 0)
            continue
        r = found[leaf.first]
        widest = max(columns, key=lambda c: ((r[f"high_{c}"] - r[f"low_{c}"]) / extent[c], -columns.index(c)))
        cuts[leaf.first] = _Search(leaf, widest, r[f"low_{widest}"], r[f"high_{widest}"], r["size"])
    while open_cuts := [c for c in cuts.values() if not c.done]:
        inside = reduce(lambda a, b: a | b, [c.holds() for c in open_cuts])
        bins = reduce(lambda out, c: F.when(F.col("node") == c.leaf.first, c.bin()).otherwise(out), open_cuts, F.lit(None))
        sums = rows.where(inside).groupBy("node", bins.alias("bin")).agg(F.sum("size").alias("size")).collect()
        for c in open_cuts:
            c.narrow({r["bin"]: r["size"] for r in sums if r["node"] == c.leaf.first})
    for c in cuts.values():
        c.leaf.cut = c.cut
    return extent


class _Search:
    """The search for one node's weighted median: first for the dimension's value, then for the tie among equal ones."""

    def __init__(self, leaf: Node, dim: str, low: int, high: int, size: int):
        self.leaf, self.dim, self.low, self.high = leaf, dim, low, high
        self.target = size * leaf.children[0].count / leaf.count
        self.near = size / PRECISION
        self.value: int | None = None
        self.below, self.done, self.cut = 0, False, None

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)

    def _key(self) -> str:
        return self.dim if self.value is None else "tie"

    def holds(self) -> Column:
        inside = (F.col("node") == self.leaf.first) & F.col(self._key()).between(self.low, self.high)
        return inside if self.value is None else inside & (F.col(self.dim) == self.value)

    def bin(self) -> Column:
        return F.expr(f"cast(({self._key()} - {self.low}L) div {self.width}L as int)")

    def narrow(self, sizes: dict[int, int]) -> None:
        below = self.below
        for b in sorted(sizes):
            if below + sizes[b] >= self.target or b == max(sizes):
                break
            below += sizes[b]
        low, high = self.low + b * self.width, min(self.high, self.low + (b + 1) * self.width - 1)
        self.below = below
        if sizes[b] <= self.near or (low == high and self.value is not None):
            after = below + sizes[b] - self.target < self.target - below  # the nearer edge of the bin
            edge = high + 1 if after else low
            self.cut = (self.dim, edge, 0) if self.value is None else (self.dim, self.value, edge)
            if self.value is not None and edge > TIE_TOP:
                self.cut = (self.dim, self.value + 1, 0)
            self.done = True
        elif low == high:
            self.value, self.low, self.high = low, 0, TIE_TOP
        else:
            self.low, self.high = low, high


def _numbered(rows: DataFrame) -> DataFrame:
    """Slots from 0 without gaps: an offset for each bucket of a shard, and the place inside the bucket."""
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return rows.withColumn("place", place).join(offsets, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
