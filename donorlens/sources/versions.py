"""Tables in versions: new ones are written beside the old, then one pointer moves for all of them.

A store is a folder. ``<store>/<table>/v-<id>`` holds the rows of one version of one table, ``<store>/_pointers`` a row for each
publication: its number and the path of every table. Adding that row, a single small file that Spark commits by renaming it,
is what publishes; until then readers see all old tables, from then on all new ones. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.sources.scratch import delete, exists

POINTERS = "number long, run string, paths string"


def _pointers(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/_pointers"
    return spark.read.schema(POINTERS).parquet(path) if exists(spark, path) else spark.createDataFrame([], POINTERS)


def current(spark: SparkSession, store: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """The number and the paths of the last publication, or of an earlier one; (0, {}) before the first."""
    rows = _pointers(spark, store)
    if number is not None:
        rows = rows.where(F.col("number") == number)
    last = rows.orderBy(F.desc("number"), F.desc("run")).limit(1).first()
    if last is None and number is not None:
        raise KeyError(f"{store} has no publication {number}")
    return (last["number"], json.loads(last["paths"])) if last else (0, {})


def publish(
    spark: SparkSession, store: str, frames: Mapping[str, DataFrame], partition_by: Mapping[str, Sequence[str]] | None = None
) -> int:
    """Write new versions of the tables in ``frames`` and make them current together; gives the publication's number.

    Other tables of the store stay as they are. A frame may read the current version of its own table. If a write fails,
    nothing changes for readers, and what was written is removed.
    """
    number, paths = current(spark, store)
    run, new = uuid.uuid4().hex, {}
    try:
        for name, df in frames.items():
            new[name] = f"{store}/{name}/v-{run}"
            df.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(new[name])
    except BaseException:
        for path in new.values():
            delete(spark, path)
        raise
    pointer = spark.createDataFrame([(number + 1, run, json.dumps(paths | new))], POINTERS)
    pointer.coalesce(1).write.mode("append").parquet(f"{store}/_pointers")
    return number + 1


def tables(spark: SparkSession, store: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of one publication, the last unless told otherwise, by one look at the pointers."""
    return {name: spark.read.parquet(path) for name, path in current(spark, store, number)[1].items()}


def register(spark: SparkSession, store: str, number: int | None = None) -> None:
    """Views in the catalog, named like the tables. A table of the catalog under such a name is an error."""
    for name, path in current(spark, store, number)[1].items():
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")


def drop_old(spark: SparkSession, store: str, keep: int = 2) -> list[str]:
    """Remove the versions that only publications before the last ``keep`` have; gives their paths."""
    listed = sorted((r["number"], r["run"], r["paths"]) for r in _pointers(spark, store).toLocalIterator())
    kept = {path for _, _, paths in listed[-keep:] for path in json.loads(paths).values()}
    old = sorted({path for _, _, paths in listed[:-keep] for path in json.loads(paths).values()} - kept)
    return [path for path in old if delete(spark, path)]
