"""Histograms of all numeric, date and time columns of a table.

Three passes, none of which shuffles values: one for ranges and approximate quantiles, one that counts buckets, one that
ranks what lies between two quantiles. The driver holds numbers for each column and bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTOGRAM = "feature string, bucket bigint, lo double, hi double, n bigint, median double, mean double"
#: Hash slots that prove how many distinct values there are at least; more buckets than that are not allowed.
SLOTS = 64
#: Quantiles are off by less than one rank in so many; so a median lies between its neighbours two such steps away.
ACCURACY = 1000
#: Most rows that are ranked one by one; above this the range is narrowed by another pass.
MAX_RANKED = 100_000
#: Groups that the second pass may return; a column of more values than that has no value groups.
MAX_GROUPS = 10_000


@dataclass
class Feature:
    """What is known of a column: its range, and [a, b] with the values of the two middle ranks, after ``below`` rows."""

    name: str
    at: int
    lo: float
    hi: float
    rows: int
    mean: float
    has_null: bool
    few: bool
    a: float
    b: float
    below: int = 0
    inside: int = 0

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.rows + 1) // 2, self.rows // 2 + 1


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric, date and time columns, by schema, outside ``exclude``."""
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def as_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; dates and times as seconds since 1970; NaN and infinities as null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz")
    time = c.cast("timestamp_ntz") if isinstance(kind, T.DateType) else c
    return F.timestamp_diff("MICROSECOND", epoch, time) / F.lit(1e6)


def histogram_table(df: DataFrame, exclude: Sequence[str] = (), max_bins: int = 20) -> DataFrame:
    """(feature, bucket, lo, hi, n, median, mean) for every column with more than one distinct value.

    Each column gets ``min(max_bins, distinct values, null included)`` equal-width buckets between its minimum and maximum.
    NaN and infinities count as null; dates and times are seconds since 1970. Values are compared as DOUBLE, so whole
    numbers beyond 2^53 may share one. The mean of a DOUBLE column is a sum in task order, exact to about 12 digits.
    """
    if not 1 <= max_bins <= SLOTS:
        raise ValueError(f"max_bins must be between 1 and {SLOTS}")
    names = numeric_features(df, exclude)
    numbers = [as_number(df, c) for c in names]
    features = _features(df, names, numbers, max_bins) if names else []
    groups = _counted(df, numbers, features, max_bins) if features else []
    rows = []
    medians = _medians(df, numbers, features)
    for f in features:
        counts: dict[float, int] = {}
        for g in groups:
            if g["feature"] == f.at:
                counts[g["key"]] = counts.get(g["key"], 0) + g["n"]
        bins, median = max_bins, medians.get(f.at)
        if f.few:
            bins, median = min(max_bins, len(counts) + f.has_null), _median_of(f, counts)
            by_bucket: dict[float, int] = {}
            for value, n in counts.items():
                bucket = min(int(bins * (value - f.lo) / (f.hi - f.lo)) + 1, bins)
                by_bucket[bucket] = by_bucket.get(bucket, 0) + n
            counts = by_bucket
        width = (f.hi - f.lo) / bins
        rows += [(f.name, int(k), f.lo + width * (k - 1), f.lo + width * k, n, median, f.mean) for k, n in sorted(counts.items())]
    return df.sparkSession.createDataFrame(rows, HISTOGRAM).orderBy("feature", "bucket")


def _features(df: DataFrame, names: Sequence[str], numbers: Sequence[Column], max_bins: int) -> list[Feature]:
    """First pass: one row. Columns with one value or none are left out."""

    def slots(x: Column) -> Column:
        slot = F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")
        return F.bit_count(F.bit_or(F.when(x.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot))))

    step = 2 / ACCURACY
    measures = {
        "lo": F.min,
        "hi": F.max,
        "rows": F.count,
        "mean": F.avg,
        "slots": slots,
        "has_null": lambda x: F.coalesce(F.max(x.isNull()), F.lit(False)),
        "near": lambda x: F.percentile_approx(x, [0.5 - step, 0.5 + step], ACCURACY),
    }
    row = df.agg(*[f(x).alias(f"{m}{i}") for i, x in enumerate(numbers) for m, f in measures.items()]).first()
    out = []
    for i, name in enumerate(names):
        lo, hi, n, mean, filled, has_null, near = (row[f"{m}{i}"] for m in measures)
        if n and lo < hi:
            a, b = (lo, hi) if n <= MAX_RANKED // 10 else near
            out.append(Feature(name, i, lo, hi, n, mean, has_null, filled < max_bins, a, b))
    return out


def _counted(df: DataFrame, numbers: Sequence[Column], features: list[Feature], max_bins: int) -> list:
    """Second pass: rows by (feature, key) where the key is the bucket, or the value itself where there are few. Also sets
    how many rows come before and inside [a, b]."""

    def cell(f: Feature) -> Column:
        x = numbers[f.at]
        bucket = F.least(F.width_bucket(x, F.lit(f.lo), F.lit(f.hi), F.lit(max_bins)), F.lit(max_bins)).cast("double")
        zone = F.when(x < f.a, -1).when(x > f.b, 1).otherwise(0)
        key, zone = (x, F.lit(0)) if f.few else (bucket, zone)
        return F.when(x.isNotNull(), F.struct(F.lit(f.at).alias("feature"), key.alias("key"), zone.alias("zone")))

    cells = df.select(F.explode(F.array(*[cell(f) for f in features])).alias("cell")).where("cell is not null")
    groups = cells.groupBy("cell").agg(F.count("*").alias("n")).select("cell.*", "n").take(MAX_GROUPS + 1)
    if len(groups) > MAX_GROUPS:
        # A column fills few slots by chance but has many values, and so at least as many as there are slots.
        for f in features:
            f.few = f.few and sum(g["feature"] == f.at for g in groups) <= SLOTS
        return _counted(df, numbers, features, max_bins)
    for f in features:
        f.below = sum(g["n"] for g in groups if g["feature"] == f.at and g["zone"] < 0)
        f.inside = sum(g["n"] for g in groups if g["feature"] == f.at and g["zone"] == 0)
    return groups


def _median_of(f: Feature, counts: dict[float, int]) -> float:
    ordered = [(value, counts[value]) for value in sorted(counts)]

    def at(rank: int) -> float:
        seen = 0
        for value, n in ordered:
            seen += n
            if seen >= rank:
                return value
        raise AssertionError("rank beyond the rows")

    return (at(f.ranks[0]) + at(f.ranks[1])) / 2


def narrowed(df: DataFrame, numbers: Sequence[Column], features: Sequence[Feature]) -> list[Feature]:
    """Narrow each [a, b] by quantiles of what lies inside until at most MAX_RANKED rows or one value is left.

    A pass leaves about one row in 250 of what was inside, or finds that one value fills the range.
    """
    while wide := [f for f in features if f.inside > MAX_RANKED and f.a < f.b]:
        quantiles, counts = [], []
        for f in wide:
            x = numbers[f.at]
            near = [min(1.0, max(0.0, (rank - f.below) / f.inside + s * 2 / ACCURACY)) for rank, s in zip(f.ranks, (-1, 1))]
            quantiles.append(F.percentile_approx(F.when(x.between(f.a, f.b), x), near, ACCURACY).alias(f"q{f.at}"))
        found = df.agg(*quantiles).first()
        for f in wide:
            f.a, f.b = found[f"q{f.at}"]
            x = numbers[f.at]
            counts += [F.count_if(x < f.a).alias(f"below{f.at}"), F.count_if(x.between(f.a, f.b)).alias(f"inside{f.at}")]
        found = df.agg(*counts).first()
        for f in wide:
            f.below, f.inside = found[f"below{f.at}"], found[f"inside{f.at}"]
    return list(features)


def _medians(df: DataFrame, numbers: Sequence[Column], features: Sequence[Feature]) -> dict[int, float]:
    """Third pass: exact medians, by ranking the distinct values inside [a, b]."""
    ranked = narrowed(df, numbers, [f for f in features if not f.few])
    for f in ranked:
        if not f.below < f.ranks[0] <= f.ranks[1] <= f.below + f.inside:
            raise AssertionError(f"{f.name}: quantiles are less accurate than promised")
    if not ranked:
        return {}
    cells = [
        F.when(numbers[f.at].between(f.a, f.b), F.struct(F.lit(f.at).alias("feature"), numbers[f.at].alias("value"))) for f in ranked
    ]
    values = df.select(F.explode(F.array(*cells)).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value"))
    ends = values.select("cell.*", "n").withColumn("upto", upto)
    middle = F.lit(False)
    for f in ranked:
        for rank in f.ranks:
            here = (F.col("upto") >= rank - f.below) & (F.col("upto") - F.col("n") < rank - f.below)
            middle = middle | ((F.col("feature") == f.at) & here)
    found: dict[int, list[float]] = {}
    for r in ends.where(middle).collect():
        found.setdefault(r["feature"], []).append(r["value"])
    return {at: (min(v) + max(v)) / 2 for at, v in found.items()}
