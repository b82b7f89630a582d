"""Vector code compression: each part of a vector becomes the number of its codebook's nearest entry.

The codebooks are refined by rounds of exact integer k-means. Vectors are laid in blocks, once, with an anchors-hierarchy tree
over each part position (`anchors.py`); a round only goes down the trees with the codebooks' candidate lists and adds up the
cached sums of the balls that one entry owns as a whole. What tasks return of a round, and what goes to them, is as large as the
codebooks, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm import anchors
from donorlens.llm.skew import attach
from donorlens.llm.store import small_batches, summed_vectors, written

#: Parts of a vector, entries of a codebook, rounds, what a component is multiplied by, and vectors of a block.
PARTS, ENTRIES, ROUNDS, SCALE, BLOCK = 16, 64, 2, 256, 4096


def _is_finite(vector: Column) -> Column:
    """Whether there is a vector and all its components are numbers."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of each component: vectors x components."""
    numbers = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), dims)
    scaled = np.floor(numbers * SCALE)
    if len(scaled) and np.abs(scaled).max() > anchors.LARGEST:
        raise ValueError(f"components must lie within {anchors.LARGEST / SCALE}")
    return scaled.astype(np.int32)


def _blocks(dims: int):
    """Rows of (vec_ids, labels, integers, trees) from rows of (vec_id, label, vector)."""

    def one_list(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                parts = _integers(some.column(2), dims).reshape(some.num_rows, PARTS, -1).swapaxes(0, 1).copy()
                trees = pickle.dumps([anchors.build(part) for part in parts])
                binary = [pa.array([value], pa.binary()) for value in (parts.tobytes(), trees)]
                ids, labels = (one_list(pa.concat_arrays([some.column(k)])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels, *binary], names=["vec_ids", "labels", "integers", "trees"])

    return run


def _read_block(batch: pa.RecordBatch, row: int, dims: int) -> tuple[np.ndarray, list[anchors.Tree]]:
    integers = np.frombuffer(batch.column("integers")[row].as_buffer(), np.int32)
    return integers.reshape(PARTS, -1, dims // PARTS), pickle.loads(batch.column("trees")[row].as_buffer())


def _sums(codebooks: np.ndarray):
    """Per task the sums, and behind them the counts, of each entry's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*codebooks.shape[:2], codebooks.shape[2] + 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                parts, trees = _read_block(batch, row, codebooks.shape[2] * PARTS)
                for k, (part, tree) in enumerate(zip(parts, trees, strict=True)):
                    sums, counts = anchors.entry_sums(tree, part, codebooks[k])
                    total[k, :, :-1] += sums
                    total[k, :, -1] += counts
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _codes(codebooks: np.ndarray):
    """Rows of (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts, trees = _read_block(batch, row, codebooks.shape[2] * PARTS)
                n = parts.shape[1]
                codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for k, (part, tree) in enumerate(zip(parts, trees, strict=True)):
                    chosen = anchors.assigned(tree, part, codebooks[k])
                    off = part.astype(np.int64) - codebooks[k][chosen]
                    codes[:, k] = chosen
                    error += np.einsum("ij,ij->i", off, off)
                text = pa.array([code.tobytes().hex() for code in codes], pa.string())
                ids, labels = batch.column("vec_ids")[row].values, batch.column("labels")[row].values
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) after `rounds`, from the `first` ones. `blocks` as `_blocks` makes them.
    An entry becomes the floor of its parts' mean; one that no part uses stays."""
    codebooks = first.astype(np.int64)
    for _ in range(rounds):
        sums = written(blocks.mapInArrow(_sums(codebooks), "sums binary"), "vector-sums")
        shape = (*codebooks.shape[:2], codebooks.shape[2] + 1)
        total = summed_vectors(sums, int(np.prod(shape)), leaf="int64").reshape(shape)
        used = total[:, :, -1:] > 0
        codebooks = np.where(used, total[:, :, :-1] // np.maximum(total[:, :, -1:], 1), codebooks)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """One row for each vector of numbers: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds nulls, NaN or infinities go. The codebooks start from the ENTRIES least ids (null ids
    last, equal ids in the order of their vectors); with fewer vectors they have fewer entries. All vectors have the length of
    the first of these whose length is a positive multiple of PARTS; a vector of another length, an empty one too, stays
    without a code or an error. Rows that repeat are rows of their own. `label_error` is the sum over equal labels, nulls
    together. Components beyond 2^26 / SCALE are an error. An empty table gives an empty result; other columns are not read.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = embeddings.select(
        embeddings[id_col].alias("vec_id"), embeddings[label_col].alias("label"), embeddings[vector_col].alias("vector")
    )
    rows = rows.where(_is_finite(F.col("vector")))
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    lengths = F.size("vector")
    by_id = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    lead = rows.where((lengths > 0) & (lengths % PARTS == 0)).orderBy(*by_id).select(lengths.alias("n")).first()
    dims = lead["n"] if lead else 0
    fitting = rows.where(lengths == dims) if dims else rows.limit(0)
    coded = spark.createDataFrame([], f"vec_id {id_kind}, label {label_kind}, code string, error long")
    sha = None
    if dims:
        least = fitting.orderBy(*by_id).limit(ENTRIES).select("vector").toArrow().column("vector").combine_chunks()
        first = _integers(least, dims).reshape(len(least), PARTS, -1).swapaxes(0, 1)
        schema = f"vec_ids array<{id_kind}>, labels array<{label_kind}>, integers binary, trees binary"
        blocks = written(fitting.mapInArrow(_blocks(dims), schema), "vector-blocks")
        codebooks = fit_codebooks(blocks, first, rounds)
        sha = digest(codebooks)
        coded = blocks.mapInArrow(_codes(codebooks), coded.schema)
    others = (rows.where(lengths != dims) if dims else rows).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(coded.union(others), "vector-codes")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = coded.withColumn("_label", key)
    totals = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    joined = attach(keyed, totals, "_label", "_rows", coded.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))
