"""Files that arrive in a landing folder, as rows of a table.

``append_new_files`` adds the files that the folder has had not before. The file source remembers in its checkpoint which it
has seen, so a run reads only new ones and a lost executor or driver leads to a retry and not to duplicates. A file that is
replaced under its old name is not new to it.

``replace_changed_files`` follows replaced (and, if asked for, removed) files too. The folder's listing is compared with a log
of all versions of its files, and what is new is added to the log; the log is the stream. Each batch of it reads the named
files and overwrites their partitions of the target, one for each file name, so that the rows of an older copy go. A batch that
is repeated after a failure writes the same partitions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from donorlens.sources.files import list_csv_files, name_contains, read_files, typed
from donorlens.sources.scratch import exists


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder for ``name`` under the cluster's shared ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set; pass a checkpoint folder that all executors can reach")
    return f"{shared.rstrip('/')}/{name}"


def new_files(spark: SparkSession, folder: str, schema: T.StructType, token: str | None = None, sep: str = ";") -> DataFrame:
    """A stream of the rows of every ``.csv`` file in ``folder``, optionally only of names that contain ``token``.

    A header that is not the schema's is an error.
    """
    options = {"sep": sep, "header": True, "escape": '"', "multiLine": True, "enforceSchema": False, "pathGlobFilter": "*.csv"}
    rows = spark.readStream.schema(schema).options(**options).csv(folder)
    return rows.where(name_contains(token)) if token else rows


def append_new_files(rows: DataFrame, target: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append everything that has arrived to the parquet folder ``target`` and stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint or checkpoint_folder(rows.sparkSession, name))
        .trigger(availableNow=True)
        .start()
    )


#: Versions of files; one that is no longer there has no path.
LOG = "name string, path string, modified timestamp, length long, noticed timestamp"
#: Columns of the target beside the rows': the file's name, and whether it is a row. A file without rows has one that isn't.
FILE, IS_ROW = "_file", "_is_row"


def log_changes(spark: SparkSession, folder: str, log: str, token: str | None = None, removed: bool = False) -> int:
    """Add the folder's files that are new, or have another time or length than their last version, to the parquet folder
    ``log``; with ``removed`` also those that have gone. Gives how many were added. Files' contents are not read."""
    listed = list_csv_files(spark, folder)
    if token:
        listed = listed.where(F.contains(F.lower("name"), F.lit(token.lower())))
    if not exists(spark, log):
        spark.createDataFrame([], LOG).write.mode("append").parquet(log)
    versions = spark.read.schema(LOG).parquet(log)
    fields = ("path", "modified", "length")
    last = versions.groupBy("name").agg(F.max_by(F.struct(*fields), F.struct("noticed", "modified")).alias("last"))
    both = listed.join(last, "name", "full" if removed else "left")
    same = F.struct(*fields[1:]).eqNullSafe(F.struct(*(F.col("last")[f] for f in fields[1:])))
    changed = both.where(~(F.col("last").isNotNull() & same)).where(F.col("path").isNotNull() | F.col("last.path").isNotNull())
    new = changed.select("name", *fields, F.current_timestamp().alias("noticed"))
    rows = new.toArrow()  # as many rows as files have changed, as any list of files to read
    if rows.num_rows:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)
    return rows.num_rows


def _replace(target: str, schema: T.StructType, sep: str, skip_unreadable: bool):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("name").agg(F.max_by("path", F.struct("noticed", "modified")).alias("path")).collect()
        if not last:
            return
        text, _ = read_files(spark, [r["path"] for r in last if r["path"]], sep, skip_unreadable, name_as=FILE)
        kept = T.StructType([*schema.fields, T.StructField(FILE, T.StringType())])
        rows = typed(text, kept).withColumn(IS_ROW, F.lit(True))
        names = spark.createDataFrame([(r["name"],) for r in last], f"{FILE} string").withColumn(IS_ROW, F.lit(False))
        _write(rows.unionByName(names, allowMissingColumns=True), target)

    return run


def _write(rows: DataFrame, target: str) -> None:
    """Overwrite the partitions of the files that the rows are of; large files are split, small ones gathered."""
    spread = rows.hint("rebalance", FILE)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FILE).parquet(target)


def replace_changed_files(
    spark: SparkSession,
    folder: str,
    target: str,
    schema: T.StructType,
    name: str,
    token: str | None = None,
    sep: str = ";",
    removed: bool = False,
    skip_unreadable: bool = False,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Bring the parquet folder ``target`` up to date with the files of ``folder`` and stop; read it with ``current_rows``.

    Only files that are new or changed are read. ``name`` is the pick-up's, under which the log and the stream's state lie.
    """
    state = checkpoint or checkpoint_folder(spark, name)
    log_changes(spark, folder, f"{state}/log", token, removed)
    return (
        spark.readStream.schema(LOG)
        .parquet(f"{state}/log")
        .writeStream.foreachBatch(_replace(target, schema, sep, skip_unreadable))
        .option("checkpointLocation", f"{state}/stream")
        .trigger(availableNow=True)
        .start()
    )


def current_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all files, with the file's name in ``_file``."""
    kept = T.StructType([*schema.fields, T.StructField(IS_ROW, T.BooleanType()), T.StructField(FILE, T.StringType())])
    return spark.read.schema(kept).parquet(target).where(IS_ROW).drop(IS_ROW)
