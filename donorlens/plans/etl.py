"""From exported files to the two analytics tables: read, clean, report, load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.operators import cleaning, profiling
from donorlens.operators.observed import Counts, written
from donorlens.schemas import to_actions, to_donations
from donorlens.sources import files, tables
from donorlens.sources.scratch import new_path

# Export columns that are dropped or converted.
ACTION_NAMES_UNUSED = [
    "CustomerActionActionTemplateIdsSystemName",
    "CustomerActionBrandIdsSystemName",
    "CustomerActionChannelIdsSystemName",
]
ACTION_CHANNEL_COPY = ["CustomerActionChannelIdsExternalId"]
ACTION_TIMES = ["CustomerActionDateTimeUtc", "CustomerActionCreationDateTimeUtc"]
ACTION_INTEGERS = ["CustomerActionChannelIdsMindboxId"]
LINE_PRICES = ("OrderLinePriceOfLine", "OrderLineBasePricePerItem")
ORDER_UNUSED = [
    "OrderDeliveryCost",
    "OrderLineNumber",
    "OrderLineLineNumber",
    "OrderFirstActionChannelIdsExternalId",
]
ORDER_TIMES = ["OrderFirstActionDateTimeUtc"]


@dataclass
class Report:
    """What cleaning changed. The tables are small and local; ``skipped_files`` could not be read."""

    removed_columns: list[str]
    changed_types: list[str]
    null_rates: DataFrame
    row_delta: DataFrame
    skipped_files: list[str] = field(default_factory=list)


def report(before: DataFrame, after: DataFrame, name: str, skipped: Sequence[str] = (), counts: Counts | None = None) -> Report:
    """With the ``counts`` of ``before`` no row is read; without, both tables are."""
    return Report(
        profiling.removed_columns(before, after),
        profiling.changed_types(before, after),
        counts.null_rates(after) if counts else profiling.null_rates(after),
        counts.row_delta(after, name) if counts else profiling.row_delta(before, after, name),
        list(skipped),
    )


def _timed(df: DataFrame, columns: Sequence[str], fmt: str | None, max_lost: float, counts: Counts | None) -> DataFrame:
    """``columns`` as timestamps; an error if a column loses more than ``max_lost`` of its values."""
    there = [c for c in columns if c in df.columns]
    timed = cleaning.to_timestamps(df, there, fmt)
    lost = (counts.lost() if counts else cleaning.lost_values(df, timed, there)) if max_lost < 1 else {}
    if bad := {c: lost[c] for c in there if lost.get(c, 0) > max_lost}:
        raise ValueError(f"times that cannot be read, as shares of the values: {bad}; another format may be needed")
    return timed


def clean_actions(
    raw: DataFrame, strict: bool = True, fmt: str | None = None, max_lost: float = 1.0, counts: Counts | None = None
) -> DataFrame:
    """``strict`` makes a missing channel-copy column an error; ``fmt`` is the format of the times; with the ``counts`` of
    ``raw`` nothing is read."""
    named = cleaning.drop_empty_columns(cleaning.drop_columns(raw, ACTION_NAMES_UNUSED), counts and counts.non_null)
    kept = cleaning.drop_columns(named, ACTION_CHANNEL_COPY, strict=strict)
    timed = _timed(kept, ACTION_TIMES, fmt, max_lost, counts)
    return cleaning.to_integers(timed, [c for c in ACTION_INTEGERS if c in kept.columns])


def clean_donations(
    raw: DataFrame, strict: bool = True, fmt: str | None = None, max_lost: float = 1.0, counts: Counts | None = None
) -> DataFrame:
    """``strict`` makes a missing unused column an error; ``fmt`` is the format of the times; with the ``counts`` of ``raw``
    nothing is read."""
    filled = cleaning.drop_empty_columns(raw, counts and counts.non_null)
    if set(LINE_PRICES) <= set(filled.columns):
        filled = cleaning.drop_if_duplicate(filled, *LINE_PRICES, counts and counts.different[LINE_PRICES])
    kept = cleaning.drop_columns(filled, ORDER_UNUSED, strict=strict)
    return _timed(kept, ORDER_TIMES, fmt, max_lost, counts)


def staged(spark: SparkSession, text: DataFrame, name: str, fmt: str | None = None) -> tuple[DataFrame, Counts]:
    """The text columns of an export, written once, and all counts that cleaning and reports need, gathered meanwhile."""
    converted = {c: cleaning.moment_of(c, fmt) for c in [*ACTION_TIMES, *ORDER_TIMES] if c in text.columns}
    converted |= {c: cleaning.whole_number(F.col(c)) for c in ACTION_INTEGERS if c in text.columns}
    if not text.columns:
        return text, Counts(0, {}, {}, {})
    return written(text, new_path(spark, f"staged-{name}"), converted, [LINE_PRICES])


def load(
    spark: SparkSession,
    folder: str,
    actions_token: str,
    orders_word: str,
    actions_table: str = "customers",
    donations_table: str = "orders",
    strict: bool = True,
    fmt: str | None = None,
    max_lost: float = 0.5,
    skip_unreadable: bool = False,
    store: str | None = None,
) -> dict[str, Report]:
    """Read the export folder, clean both datasets, replace the analytics tables together and return the reports.

    Files whose name contains ``actions_token`` (any case) are actions; the first other file whose name contains
    ``orders_word`` holds the donations. The tables get the model's columns and every other cleaned one. ``fmt`` is the
    format of the times; a time column that loses more than ``max_lost`` of its values is an error. A file that cannot be
    read is an error too, or left out as a whole and named in the report with ``skip_unreadable``.

    The exports are parsed once, into staged text columns; all that cleaning decides by and all that the reports say is counted
    while that is written. The tables are published in ``store`` (see ``sources.versions``) and get views of their names.
    """
    action_files, others = files.split_by_token(files.csv_paths(spark, folder), actions_token)
    orders_file = files.first_named(others, orders_word)
    stages, reports = {}, {}
    sides = (
        (actions_table, action_files, clean_actions, to_actions),
        (donations_table, [orders_file] if orders_file else [], clean_donations, to_donations),
    )
    for table, paths, clean, model in sides:
        text, skipped = files.read_files(spark, paths, skip_unreadable=skip_unreadable)
        raw, counts = staged(spark, text, table, fmt)
        cleaned = clean(raw, strict, fmt, max_lost, counts)
        stages[table] = model(cleaned)
        reports[table] = report(raw, cleaned, table, skipped, counts)
    tables.load_tables(spark, stages, store)
    return reports
