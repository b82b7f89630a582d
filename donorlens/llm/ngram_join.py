"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of distinct word 5-grams, as 64-bit hashes; equal sets are one entity. Counts of all shingles in a
fixed number of hash buckets give a global order in which rare ones come first. Two entities whose sets are similar enough
share a shingle among the first of each (the prefix). So entities meet on the shingles of their prefixes; of those that meet, length
and positions rule out most; the rest are verified once on their sets, after a bound on their suffixes.

The result is components, so not all pairs are needed where many entities meet on one shingle. There, a signature of each
set (parities of its counts in 1024 hash ranges) bounds the difference of two sets from below, as a suffix filter does. First
each entity meets one or two others that pass; after that, all those that pass and are not yet in one component. That loses
no link between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from donorlens.llm.components import connected_components
from donorlens.llm.features import _mix, buffers, pieces, shingles, words
from donorlens.llm.skew import attach
from donorlens.llm.store import small_batches, summed_vectors, trimmed, written

WORDS = 5
#: Documents link when NUMERATOR / DENOMINATOR of the union is shared.
NUMERATOR, DENOMINATOR = 75, 100
COUNT_BITS = 20
#: Groups of up to so many entities meet all at once.
SMALL_GROUP = 4
SIGNATURE_BITS = 1024
#: Bytes of prefix entries that one task sorts. Fewer parts leave more entries of one set side by side, which pack better.
TASK_BYTES = 32 << 20
MIN_PARTS = 12
#: Hash ranges in which the suffix filter counts.
RANGES = 32
MAP_BITS = 23
ENTRY = np.dtype([("shingle", "<u8"), ("entity", "<u8"), ("n", "<u4"), ("place", "<u4")])


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, part in pieces(texts):
        data, offsets = buffers(part)
        _, _, hashes, first = words(data, offsets)
        runs, at = shingles(hashes, first, WORDS)
        for i in range(len(part)):
            yield np.unique(runs[at[i] : at[i + 1]])


def _digest(shingle_set: np.ndarray, seed: int) -> int:
    return int(np.sum(_mix(shingle_set ^ np.uint64(seed)), dtype=np.uint64))


#: Two independent digests of a set; the first names the entity in candidate pairs.
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


MEMBER = np.dtype([*ENTRY.descr, ("signature", "<u8", SIGNATURE_BITS // 64), ("root", "<u8")])


def needed(nx, ny):
    """The least intersection of sets of these sizes that link: share x union = share x (nx + ny - intersection)."""
    return -(-NUMERATOR * (nx + ny) // (NUMERATOR + DENOMINATOR))


def prefix_sizes(n):
    """Shingles of the prefix that a set needs against smaller sets, and against larger ones (or equal)."""
    least = -(-NUMERATOR * n // DENOMINATOR)
    return n - least + 1, n - needed(n, n) + 1


def signature(shingle_set: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of SIGNATURE_BITS ranges: sets that differ in k shingles differ in k bits at most."""
    counts = np.bincount((shingle_set & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64), minlength=SIGNATURE_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _profiled(id_type: pa.DataType):
    """Per document the size and digests of its set; at the end a row with n = -1 and the counts per bucket."""
    names = ["doc_id", "n", "d1", "d2", "signature", "counts"]
    types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            n, d1, d2, signatures = [], [], [], []
            for s in _sets(batch.column(1)):
                n.append(len(s))
                d1.append(_digest(s, _SEEDS[0]))
                d2.append(_digest(s, _SEEDS[1]))
                signatures.append(signature(s))
                np.add.at(counts, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            digests = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]
            columns = [batch.column(0), pa.array(n, pa.int64()), *digests, pa.array(signatures, pa.binary())]
            columns.append(pa.nulls(len(n), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        last = [None, -1, 0, 0, None, counts.astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names=names)

    return run


def _order(counts: np.ndarray) -> np.ndarray:
    """Bucket counts as codes of a few bits: the order need only tell rare from frequent, at any size."""
    return np.round(16 * np.log2(1 + counts)).astype(np.uint16)


def rare_first(shingle_set: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The set in the global order: by code, then by hash (the set comes sorted, and the sort is stable)."""
    return shingle_set[np.argsort(codes[shingle_set >> np.uint64(64 - COUNT_BITS)], kind="stable")]


def _prefix_entries(codes: np.ndarray, parts: int):
    """Prefixes as packed entries, a row for each batch and part of the hash space; equal sets of a task appear once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for s in _sets(batch.column(0)):
                if not len(s) or (key := (_digest(s, _SEEDS[0]), len(s))) in seen:
                    continue
                seen.add(key)
                prefix = rare_first(s, codes)[: max(prefix_sizes(len(s)))]
                entries = np.empty(len(prefix), ENTRY)
                entries["shingle"], entries["entity"], entries["n"] = prefix, key[0], len(s)
                entries["place"] = np.arange(len(prefix))
                out.append(entries)
            if not out:
                continue
            entries = np.concatenate(out)
            part = (entries["shingle"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            present, begins = np.unique(part, return_index=True)
            blocks = np.split(entries, begins[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(present, pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["part", "block"]
            )

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition's entries, those whose shingle another entity has too, in groups."""
    blocks = [np.frombuffer(v.as_buffer(), ENTRY) for batch in batches for v in batch.column(1)]
    if not blocks:
        return
    entries = np.concatenate(blocks)
    del blocks
    # Equal sets of different tasks have equal entries.
    order = np.lexsort((entries["entity"], entries["n"], entries["shingle"]))
    entries = entries[order]
    fresh = np.ones(len(entries), bool)
    fresh[1:] = (np.diff(entries["shingle"]) != 0) | (np.diff(entries["entity"]) != 0)
    entries = entries[fresh]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(entries["shingle"]) != 0]))
    sizes = np.diff(np.concatenate([begins, [len(entries)]]))
    entries = entries[np.repeat(sizes > 1, sizes)]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(entries["shingle"]) != 0])) if len(entries) else np.zeros(0, int)
    at = 0
    ends = np.concatenate([begins[1:], [len(entries)]]) if len(begins) else begins
    for k, end in enumerate(ends):
        if end - at >= 100_000 or k == len(ends) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([entries[at:end].tobytes()], pa.binary())], names=["groups"])
            at = end


def _passing(nx: np.ndarray, px: np.ndarray, ny: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Which pairs the prefix, length and positional filters leave, by sizes and places; x is the smaller set of each."""
    alpha = needed(nx, ny)
    in_prefix = (px < nx - needed(nx, nx) + 1) & (py < ny + (-NUMERATOR * ny // DENOMINATOR) + 1)
    most = np.minimum(px, py) + 1 + np.minimum(nx - px, ny - py) - 1
    return in_prefix & (nx >= alpha) & (most >= alpha)


def _ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    swap = (x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["entity"] > y["entity"]))
    return np.where(swap, y, x), np.where(swap, x, y)


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    small, large = _ordered(x, y)
    keep = _passing(*(s[c].astype(np.int64) for s in (small, large) for c in ("n", "place")))
    return np.stack([small["entity"][keep], large["entity"][keep]], 1)


def _emit(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 2), np.uint64), *found])
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 0)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"]
    )


def _bounds(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], np.diff(shingle) != 0]))
    return begins, np.diff(np.concatenate([begins, [len(shingle)]]))


def _small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of small groups, all groups of one size at once."""
    for batch in batches:
        for value in batch.column(0):
            entries = np.frombuffer(value.as_buffer(), ENTRY)
            begins, sizes = _bounds(entries["shingle"])
            found = []
            for size in range(2, SMALL_GROUP + 1):
                groups = begins[sizes == size]
                found += [_pairs(entries[groups + i], entries[groups + j]) for i in range(size) for j in range(i + 1, size)]
            yield _emit(found)


def _within_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and signatures those whose sets may be near enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(batch.num_rows, -1) for k in (4, 5))
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        keep = np.bitwise_count(a ^ b).sum(1).astype(np.int64) <= total - 2 * needed(total, 0)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _large_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0):
            entries = np.frombuffer(value.as_buffer(), ENTRY)
            _, sizes = _bounds(entries["shingle"])
            rows = entries[np.repeat(sizes > SMALL_GROUP, sizes)]
            as_long = lambda c: pa.array(rows[c].astype(np.uint64).view(np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([as_long(c) for c in ENTRY.names], names=list(ENTRY.names))


def _member_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole groups of rows that come in order of their shingle: shingle, entity, n, place, signature, root."""
    rest = np.zeros(0, MEMBER)
    for batch in batches:
        rows = np.empty(batch.num_rows, MEMBER)
        for k, c in enumerate(ENTRY.names):
            rows[c] = batch.column(k).to_numpy().view(np.uint64)
        rows["signature"] = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(len(rows), -1)
        rows["root"] = batch.column(5).to_numpy().view(np.uint64)
        rows = np.concatenate([rest, rows])
        if len(rows):
            begins, _ = _bounds(rows["shingle"])
            rest = rows[begins[-1] :]
            yield np.split(rows[: begins[-1]], begins[1:-1]) if begins[-1] else []
    if len(rest):
        yield [rest]


class _Group:
    """The members of a group as columns: comparing one with all others is done with whole columns."""

    def __init__(self, rows: np.ndarray):
        self.n, self.place = rows["n"].astype(np.int64), rows["place"].astype(np.int64)
        self.entity, self.signature = np.ascontiguousarray(rows["entity"]), np.ascontiguousarray(rows["signature"])

    def near(self, i: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the members `among` those that may link with member i by all filters, and by how many bits they differ. Lengths
        and places go first, signatures are compared of what they leave."""
        n, place = self.n[i], self.place[i]
        na, pa_ = self.n[among], self.place[among]
        is_small = (n < na) | ((n == na) & (self.entity[i] < self.entity[among]))
        nx, ny = np.where(is_small, n, na), np.where(is_small, na, n)
        px, py = np.where(is_small, place, pa_), np.where(is_small, pa_, place)
        among = among[_passing(nx, px, ny, py)]
        bits = np.bitwise_count(self.signature[among] ^ self.signature[i]).sum(1, dtype=np.int64)
        total = n + self.n[among]
        keep = bits <= total - 2 * needed(total, 0)
        return among[keep], bits[keep]

    def pairs(self, i: int, others: np.ndarray) -> np.ndarray:
        """Names of member i and of each of the others, the smaller set first."""
        n, entity = self.n[others], self.entity[others]
        is_small = (self.n[i] < n) | ((self.n[i] == n) & (self.entity[i] <= entity))
        return np.stack([np.where(is_small, self.entity[i], entity), np.where(is_small, entity, self.entity[i])], 1)


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of large groups: a member and all it may link with, then one that is left, and so on; each also with the nearest of
    those before. So a group of m members gives 2 m pairs at most."""
    for groups in _member_groups(batches):
        found = []
        for rows in groups:
            group, left = _Group(rows), np.ones(len(rows), bool)
            everyone = np.arange(len(rows))
            for i in range(len(rows)):
                if not left[i]:
                    continue
                left[i] = False
                near, bits = group.near(i, everyone)
                near, bits = near[near != i], bits[near != i]
                if not len(near):
                    continue
                found.append(group.pairs(i, near[left[near]]))
                before = ~left[near]
                if before.any():
                    found.append(group.pairs(i, near[before][[bits[before].argmin()]]))
                left[near] = False
        yield _emit(found)


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of large groups: all pairs that may link and lie in different components."""
    for groups in _member_groups(batches):
        found = []
        for group in groups:
            roots, of, sizes = np.unique(group["root"], return_inverse=True, return_counts=True)
            if len(roots) == 1:
                continue
            order = np.argsort(of == sizes.argmax(), kind="stable")  # the largest component last
            columns, of = _Group(group[order]), of[order]
            for i in range(len(order) - int(sizes.max())):
                others = np.arange(i + 1, len(order))
                near, _ = columns.near(i, others[of[i + 1 :] != of[i]])
                if len(near):
                    found.append(columns.pairs(i, near))
        yield _emit(found)


def _set_rows(wanted: np.ndarray):
    """The sets of entities that the bit map `wanted` names (some others may be among them), once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for s in _sets(batch.column(0)):
                entity = _digest(s, _SEEDS[0])
                place = entity >> (64 - MAP_BITS)
                if not len(s) or not wanted[place >> 3] >> (place & 7) & 1:
                    continue
                key = (entity, _digest(s, _SEEDS[1]))
                if key not in seen:
                    seen.add(key)
                    out.append((*key, s.tobytes()))
            as_long = lambda k: pa.array(np.array([r[k] for r in out], np.uint64).view(np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [as_long(0), as_long(1), pa.array([r[2] for r in out], pa.binary())], names=["entity", "other", "shingles"]
            )

    return run


def _bit_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link. The suffix filter first: in each range of hashes they share the lesser count at most."""
    alpha = needed(len(x), len(y))
    if min(len(x), len(y)) < alpha:
        return False
    edges = (np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)).astype(np.uint64)
    count = lambda s: np.diff(np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]))
    if np.minimum(count(x), count(y)).sum() < alpha:
        return False
    places = np.searchsorted(y, x)
    return int((y[np.minimum(places, len(y) - 1)] == x).sum()) >= alpha


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(k)] for k in (2, 3)]
        linked = pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), linked], names=["a", "b", "linked"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verify each pair of entities once: (a, b) as names of sets, those that link."""
    ids = pairs.select("a").union(pairs.select("b"))
    maps = ids.mapInArrow(trimmed(_bit_map), "bits binary")
    wanted = summed_vectors(maps, 1 << (MAP_BITS - 3), "uint8", "uint8", np.bitwise_or)
    sets = texts.mapInArrow(trimmed(_set_rows(wanted)), "entity long, other long, shingles binary")
    name = F.concat(F.lpad(F.hex("entity"), 16, "0"), F.lpad(F.hex("other"), 16, "0"))
    # Dealt by entity once: for dropping repeated sets and for both joins.
    sets = sets.select("entity", name.alias("name"), "shingles").repartition("entity").dropDuplicates(["entity", "name"])
    left, right = (sets.select(F.col("entity").alias(k), F.col("name").alias(f"name_{k}"), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    rows = pairs.join(left, "a").join(right, "b").select("name_a", "name_b", "set_a", "set_b")
    return rows.mapInArrow(trimmed(_verified), "a string, b string, linked boolean").where("linked").select("a", "b")


def _joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: the components' roots are the vertices of a smaller graph."""
    root_of = lambda c: labels.select(F.col("vertex").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    edges = edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a != b")
    upper = connected_components(written(edges.distinct(), "join-edges")).toDF("at", "top")
    known = labels.join(upper, F.col("root") == F.col("at"), "left").select("vertex", F.coalesce("top", "root").alias("root"))
    alone = upper.join(labels.select("vertex"), F.col("at") == F.col("vertex"), "left_anti").toDF("vertex", "root")
    return written(known.union(alone), "join-labels")


def _named(place: int, column: str):
    """All columns, and the name of each row's set in `column`: empty without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{_digest(s, _SEEDS[0]):016X}{_digest(s, _SEEDS[1]):016X}" if len(s) else "" for s in _sets(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, column])

    return run


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all their columns, without those that have a smaller id in their component.

    Rows without words (null and empty texts too) stay. Of rows that repeat the smallest id and the set, one stays. Null ids
    are larger than any other. Columns may have any names and are passed on; an empty table gives an empty result.
    """
    taken = {c.lower() for c in df.columns}
    # Names that no column of the rows has.
    name, key, kept, copy = (next(x for n in range(len(taken) + 1) if (x := f"_{c}{n}") not in taken) for c in ("set", "key", "kept", "copy"))
    profiled = components(df, id_col, text_col)
    first = profiled.where((F.col("n") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    of_first = F.concat_ws(":", "name", F.col("doc_id").cast("string"))
    counts = written(first.groupBy(of_first.alias(kept)).agg(F.count(F.lit(1)).alias("n")), "join-kept")
    schema = StructType([*df.schema.fields, StructField(name, StringType())])
    rows = df.mapInArrow(trimmed(_named(df.columns.index(text_col), name)), schema)
    # The id is part of the key, so a large group doesn't meet in one task; rows without words have no partner.
    own = F.when(F.col(name) != "", F.concat_ws(":", name, rows[id_col].cast("string")))
    spread = F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if kind in ("string", "bigint", "int", "double")))
    rows = rows.withColumn(key, F.coalesce(own, F.concat(F.lit("-"), spread.cast("string"))))
    found = rows.join(counts.select(kept), F.col(key) == F.col(kept), "left").where((F.col(name) == "") | F.col(kept).isNotNull())
    if not counts.where("n > 1").isEmpty():
        found = found.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(copy) == 1)
    return found.select(*(f"`{c}`" for c in df.columns))


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, text_copies.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; shingles are five words, or the whole sequence of fewer. Documents
    link when their sets' Jaccard similarity is at least 0.75; `component_id` is the smallest id that links reach, `text_copies`
    the number of rows with the same set. Null texts and texts without words have no shingles, link with nothing and have
    themselves as component. Null ids are larger than any other; a component of null ids has a null id. Repeated rows link
    with each other. An empty table gives an empty result. Other columns are not read.
    """
    return components(df, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("text_copies", F.lit(0)).alias("text_copies")
    )


def components(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, n, name (of its set), component_id, text_copies (null without shingles)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    texts = rows.select("text")
    profile = _profiled(to_arrow_type(df.schema[id_col].dataType))
    profiles = rows.mapInArrow(trimmed(profile), f"doc_id {kind}, n long, d1 long, d2 long, signature binary, counts binary")
    profiles = written(profiles, "join-profiles")
    counts = summed_vectors(profiles.where("n = -1").select("counts"), 1 << COUNT_BITS)
    docs = profiles.where("n >= 0").select(
        "doc_id", "n", F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0")).alias("name")
    )
    parts = max(MIN_PARTS, int(counts.sum()) // 4 * ENTRY.itemsize // TASK_BYTES)
    blocks = texts.mapInArrow(trimmed(_prefix_entries(_order(counts), parts)), "part long, block binary")
    groups = written(blocks.repartition(parts, "part").mapInArrow(trimmed(_grouped), "groups binary"), "join-groups")
    members = groups.mapInArrow(trimmed(_large_members), "shingle long, entity long, n long, place long")
    signatures = profiles.where("n > 0").select(F.col("d1").alias("entity"), F.col("n").alias("size"), "signature")
    signatures = signatures.dropDuplicates(["entity"])
    members = written(members.join(signatures.drop("size"), "entity").select(*ENTRY.names, "signature"), "join-members")

    def met(rows: DataFrame, how) -> DataFrame:
        return rows.repartition("shingle").sortWithinPartitions("shingle", "entity").mapInArrow(trimmed(how), "a long, b long")

    first = met(members.withColumn("root", F.col("entity")), _first_pairs)
    small = groups.mapInArrow(trimmed(_small_pairs), "a long, b long").distinct()
    small = small.join(signatures.toDF("a", "size_a", "signature_a"), "a").join(signatures.toDF("b", "size_b", "signature_b"), "b")
    small = small.select("a", "b", "size_a", "size_b", "signature_a", "signature_b").mapInArrow(trimmed(_within_signatures), "a long, b long")
    pairs = written(small.union(first).distinct(), "join-pairs")
    links = written(_links(pairs, texts), "join-links")
    labels = connected_components(links)
    root = F.conv(F.substring("root", 1, 16), 16, -10).cast("long")
    by_entity = labels.select(F.conv(F.substring("vertex", 1, 16), 16, -10).cast("long").alias("entity"), root.alias("root"))
    placed = members.join(by_entity.dropDuplicates(["entity"]), "entity", "left")
    placed = placed.select(*ENTRY.names, "signature", F.coalesce("root", "entity").alias("root"))
    cross = met(placed, _cross_pairs).distinct().join(pairs, ["a", "b"], "left_anti")
    cross = written(cross, "join-cross")
    if not cross.isEmpty():
        labels = _joined_labels(labels, _links(cross, texts))
    classes = docs.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("text_copies"))
    rooted = classes.join(labels.withColumnRenamed("vertex", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(rooted.join(ids, "root").select("name", "component_id", "text_copies"), "join-classes")
    total = facts.agg(F.sum("text_copies")).first()[0] or 0
    full = attach(docs, facts, "name", "text_copies", total)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n", "name", own.alias("component_id"), "text_copies")
