"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from donorlens.sources.scratch import delete, new_path


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, where they don't find it by PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_has_donorlens", False):
        return
    # The driver's own copy; Spark hands it to the executors.
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='llm-package-')}/donorlens", "zip", root, "donorlens"))
    sc._has_donorlens = True


#: Bytes of texts that go to a Python worker at a time.
BATCH_BYTES = 8 << 20
#: Characters of a plan as text. The driver keeps these texts of up to a thousand executions, and makes them anew each time that
#: a running plan changes; those of many joins are long.
PLAN_TEXT = 5_000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to BATCH_BYTES in this session: texts are long, and a batch exists in several copies. Keep plans as
    text to PLAN_TEXT, unless the session sets a length of its own."""
    length = spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")
    if length.isdigit() and int(length) > 1 << 30:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{64 << 20}b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Paths that `written` has made, in order; and after how many tables the driver's garbage is collected. Spark lets go of what
#: broadcasts and shuffles hold on the driver only then, and its heap does not shrink otherwise.
_WRITTEN: list[str] = []
COLLECT_EVERY = 4
_tables = itertools.count(1)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: its lineage ends there, so a lost executor
    costs a read, not a recomputation."""
    path = new_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    if next(_tables) % COLLECT_EVERY == 0:
        df.sparkSession._jvm.System.gc()
    release_driver_memory(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int | None = None) -> int:
    """Delete what `written` has made since there were so many tables, but for the last one. Gives how many there are now."""
    if since is not None:
        for path in _WRITTEN[since:-1]:
            delete(spark, path)
        del _WRITTEN[since:-1]
    return len(_WRITTEN)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def merged_vectors(vectors: DataFrame, size: int, dtype: str = "int64", leaf: str = "int32", combine=np.add) -> DataFrame:
    """The sum (or else `combine`) of the byte vectors in the only column of `vectors`, each of `size` numbers, as one row. They
    are merged in a tree, so that no task holds more than 16 of them. The vectors are of type `leaf`, sums of type `dtype`."""
    column = vectors.columns[0]

    def numbers(value: memoryview) -> np.ndarray:
        return np.frombuffer(value, leaf if len(value) == size * np.dtype(leaf).itemsize else dtype)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for value in batch.column(0):
                combine(total, numbers(memoryview(value.as_buffer())), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=[column])

    parts = vectors.rdd.getNumPartitions()
    while True:
        parts = max(1, -(-parts // 16))
        vectors = vectors.repartition(parts).mapInArrow(merge, vectors.schema)
        if parts == 1:
            return vectors


def summed_vectors(vectors: DataFrame, size: int, dtype: str = "int64", leaf: str = "int32", combine=np.add) -> np.ndarray:
    """`merged_vectors` on the driver: `size` is a fixed parameter of the caller, so what comes is bounded."""
    row = merged_vectors(vectors, size, dtype, leaf, combine).first()
    total = np.frombuffer(row[0], dtype).copy() if row else np.zeros(size, dtype)
    del row
    release_memory()
    release_driver_memory(vectors.sparkSession)
    return total


def trimmed(run):
    """The function for `mapInArrow`, giving its freed memory back when a task ends. Workers live on for other tasks, and what
    each of an executor's workers keeps adds up."""

    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return with_release


def release_memory() -> None:
    """Give freed memory back to the system: large arrays that went leave holes which the allocator keeps."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def release_driver_memory(spark: SparkSession) -> None:
    """The same for the driver's JVM, outside its heap: its hundreds of threads (planning, broadcasts, shuffles, compilers) allocate
    in many arenas, and each keeps what they freed. OpenJDK 17 with glibc has a command for it; elsewhere nothing happens."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        out = new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    lang, named = jvm.java.lang, jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        takes = [commands.getClass(), *map(named, ("java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))]
        # The method of the interface: the server's own class is not public.
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *takes))
        invoke.invoke(server, array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
