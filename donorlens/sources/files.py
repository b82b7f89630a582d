"""Delimited exports in a landing folder.

Files are picked by name inside one distributed read; the driver lists names only where a caller asks for them.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    sep: str = ";",
    multi_line: bool | None = None,
    **options: str,
) -> DataFrame:
    """Delimited text with a header. Without ``schema`` types are inferred, which costs one more pass over the data.

    Quotes inside a quoted value are doubled. ``multi_line`` allows line breaks there, at the price that a file is read by
    one task. Unless it is given, a pass over the lines finds out whether any value needs it; without such values large files
    are read by many tasks. A header that is not the schema's is an error.
    """
    if multi_line is None:
        multi_line = bool(spark.read.text(path if isinstance(path, str) else list(path)).agg(F.bool_or(_ends_inside_quotes())).first()[0])
    options = {"enforceSchema": "false", **options}
    reader = spark.read.options(sep=sep, header=True, escape='"', multiLine=multi_line, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def _ends_inside_quotes() -> Column:
    """Whether a line of text has an odd number of quotes, so that a value goes on in the next one."""
    return F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2)) == 1


def file_name() -> Column:
    return F.col("_metadata.file_name")


def decoded_name() -> Column:
    return F.url_decode(F.replace(file_name(), F.lit("+"), F.lit("%2B")))


def name_contains(token: str, case_sensitive: bool = False) -> Column:
    name = decoded_name()
    return name.contains(token) if case_sensitive else F.lower(name).contains(token.lower())


def list_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, modified, length) of the folder's files ending in ``.csv`` (lower case), without reading their content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")
    )


def read_routed(
    spark: SparkSession, folder: str, token: str, schema: T.StructType, sep: str = ";", skip_unreadable: bool = False
) -> tuple[DataFrame, DataFrame]:
    """All ``.csv`` files of a folder in two tables: names that contain ``token`` in any case, and the others.

    Columns are matched by name; see ``read_files`` for files that cannot be read.
    """
    sides = split_by_token(csv_paths(spark, folder), token)
    both = [typed(read_files(spark, paths, sep, skip_unreadable)[0], schema) for paths in sides]
    return both[0], both[1]


def typed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the schema's names and types; what cannot be converted is null, and so are columns that are missing."""
    return text.select(
        *[(F.col(f"`{f.name}`") if f.name in text.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def csv_paths(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folder's ``.csv`` files in name order, empty ones included. The list is as long as the folder has files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).inputFiles()
    return sorted((unquote(path) for path in listed), key=_name)


def split_by_token(paths: Sequence[str], token: str) -> tuple[list[str], list[str]]:
    """Paths whose file name contains ``token`` in any case, and the others."""
    sides: tuple[list[str], list[str]] = ([], [])
    for p in paths:
        sides[token.lower() not in _name(p).lower()].append(p)
    return sides


def first_named(paths: Sequence[str], word: str) -> str | None:
    """The first path whose file name contains ``word``."""
    return next((p for p in paths if word in _name(p)), None)


def read_first_named(
    spark: SparkSession, folder: str, word: str, schema: T.StructType, sep: str = ";", exclude: str | None = None
) -> DataFrame:
    """The folder's first file whose name contains ``word`` (and not ``exclude`` in any case), or an empty table."""
    paths = csv_paths(spark, folder)
    candidates = split_by_token(paths, exclude)[1] if exclude else paths
    path = first_named(candidates, word)
    return typed(read_by_name(spark, [path] if path else [], sep), schema)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str | None, bool]]:
    """The first line of each file, None for a file that is empty or not UTF-8, and whether a value has a line break inside
    quotes. One distributed pass over all files."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("line"),
        "value",
        F.is_valid_utf8("value").alias("valid"),
        _ends_inside_quotes().alias("open"),
    )
    found = lines.groupBy("path").agg(
        F.min_by("value", "line").alias("header"), F.every("valid").alias("valid"), F.bool_or("open").alias("open")
    )
    by_name = {_decoded(r["path"]): (r["header"] if r["valid"] else None, r["open"]) for r in found.toLocalIterator()}
    return {p: by_name.get(_decoded(p), (None, False)) for p in paths}


def _decoded(path: str) -> str:
    return re.sub("^file:/+", "/", unquote(path))


def _columns(header: str, sep: str) -> tuple[str, ...]:
    """Column names of a header line; a name that comes again gets a number."""
    names: list[str] = []
    for name in next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep)):
        n = sum(other == name or re.fullmatch(re.escape(name) + r"\.[0-9]+", other) is not None for other in names)
        names.append(f"{name}.{n}" if name in names else name)
    return tuple(names)


def read_files(
    spark: SparkSession, paths: Sequence[str], sep: str = ";", skip_unreadable: bool = False, name_as: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Files with headers of their own as one table of text columns, and the paths that were left out.

    Columns are matched by name, missing ones are null. Files with equal headers share one read, so the plan grows with the
    number of layouts and jobs do not grow with the number of files. Only files in which a quoted value has a line break are
    read by one task each. ``name_as`` is a column for the file's name. Empty files and files that are not UTF-8 are an error,
    or left out as a whole with ``skip_unreadable``; an error of the storage always fails the read.
    """
    layouts: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    unreadable = []
    for path, (header, multi_line) in headers(spark, paths).items() if paths else ():
        if header:
            layouts.setdefault((_columns(header, sep), multi_line), []).append(path)
        else:
            unreadable.append(path)
    if unreadable and not skip_unreadable:
        raise ValueError(f"files that are empty or not UTF-8: {unreadable[:10]} ({len(unreadable)} in all)")
    if not layouts:
        return spark.createDataFrame([], T.StructType([])), unreadable
    parts = []
    for (header, multi_line), same in layouts.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        # The headers have just been read; names that had to be numbered differ from those in the file.
        part = read_csv(spark, same, schema, sep, multi_line, enforceSchema="true")
        parts.append(part.select("*", decoded_name().alias(name_as)) if name_as else part)
    return union_all(parts), unreadable


def read_by_name(spark: SparkSession, paths: Sequence[str], sep: str = ";") -> DataFrame:
    """The table of ``read_files``; a file that cannot be read is an error."""
    return read_files(spark, paths, sep)[0]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, missing ones null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def read_modified_after(
    spark: SparkSession, folder: str, since: dt.datetime, schema: T.StructType, sep: str = ";"
) -> DataFrame:
    """Only files changed after ``since`` (in the session time zone)."""
    stamp = F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    changed = list_csv_files(spark, folder).where(F.col("modified") > stamp).orderBy("name").select("path")
    return typed(read_by_name(spark, [row["path"] for row in changed.toLocalIterator()], sep), schema)


def newest_versions(files: DataFrame, name: str = "name", modified: str = "modified") -> DataFrame:
    """One row per file name: its most recently changed copy."""
    newest = Window.partitionBy(name).orderBy(F.desc(modified), F.desc("path"))
    return files.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def read_newest(spark: SparkSession, folders: Sequence[str], schema: T.StructType, sep: str = ";") -> DataFrame:
    """Rows of the newest copy of every file name found in ``folders``; older copies are skipped.

    The driver holds the list of paths that are read, as Spark itself does for any read.
    """
    listed = reduce(DataFrame.unionByName, [list_csv_files(spark, folder) for folder in folders])
    newest = newest_versions(listed).select("path")
    paths = [row["path"] for row in newest.toLocalIterator()]
    return typed(read_by_name(spark, paths, sep), schema)
