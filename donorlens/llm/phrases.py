"""Phrase collocations by Toivonen's mining: a sample proposes, one pass over everything counts exactly.

Phrases that are frequent in a sample, at a lowered threshold, are proposed level by level. A full pass then counts them and
their negative border: the phrases whose two shorter parts (without the first and without the last word) are all proposed
though they are not. A border phrase that turns out frequent is a failure: what it opens is counted in another pass, until a
pass has no failures. What is proposed goes to the tasks as a bit map of bounded size. A phrase that its bits let through by
accident is counted for nothing; none is missed, and every count is of all occurrences.

Phrases are counted as 64-bit hashes. The frequent ones are spelled out from a few documents, those that these don't hold from
all. From these few rows the scores come by joins.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.features import _mix, buffers, pieces, words
from donorlens.llm.skew import attach
from donorlens.llm.store import small_batches, written

#: Words of the longest phrase, the least count of a candidate, and phrases given for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Share of the rows in the sample, and part of the count expected there from which on a phrase is proposed.
SHARE, LOWERED = 1 / 8, 0.6
#: Expected occurrences of the rarest frequent phrases in the documents that phrases are spelled out from first.
SPELLED = 3
#: Bits of a map of phrases: a power of two between these, BITS_EACH times the phrases if that lies between.
LEAST_BITS, MOST_BITS, BITS_EACH = 20, 26, 32
#: Keys that a task gathers before it combines their counts.
GATHERED = 1 << 21

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


@dataclass(frozen=True)
class BitMap:
    """A set of 64-bit hashes, each of which has two bits. Without words it is empty."""

    bits: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), bool)
        out = np.ones(len(keys), bool)
        for at in (keys >> np.uint64(64 - self.bits), (keys >> np.uint64(8)) & np.uint64((1 << self.bits) - 1)):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bit_map(keys: DataFrame, bits: int) -> BitMap:
    """The map of the column `key`. At most 2^(bits - 6) numbers come to the driver."""
    key = F.col("key")
    places = F.array(F.shiftrightunsigned(key, 64 - bits), F.shiftrightunsigned(key, 8).bitwiseAND(F.lit((1 << bits) - 1)))
    at = keys.select(F.explode(places).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return BitMap(bits, out)


@dataclass(frozen=True)
class _Piece:
    """Words of some texts: their bytes in `data`, their hashes (with the language), and whether the next one follows in the
    same piece of the same text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    together: np.ndarray


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _read(texts: pa.Array, langs: list[str]) -> _Piece:
    data, offsets = buffers(texts)
    starts, ends, hashes, first = words(data, offsets, between=_BETWEEN)
    ended = np.concatenate([[0], np.cumsum(_ENDS[data], dtype=np.int32)])
    together = np.zeros(len(starts), bool)
    together[:-1] = ended[starts[1:]] == ended[ends[:-1]]
    last = first[1:] - 1
    together[last[np.diff(first) > 0]] = False
    of_lang = {lang: _language_hash(lang) for lang in set(langs)}
    salt = np.array([of_lang[lang] for lang in langs], np.uint64)
    return _Piece(data, starts, ends, _mix(hashes + np.repeat(salt, np.diff(first))), first, together)


def _levels(
    piece: _Piece, known: BitMap, before: dict[int, np.ndarray] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the places where a phrase begins that may be counted, as all its shorter parts are known; the hash of
    each; and whether it is known itself. All words may be counted. `before`: places by length that were counted before; what
    was not counts as known, until its count shows more."""
    keys, places = piece.hashes, np.arange(len(piece.hashes))
    n = len(keys)
    for length in range(1, LONGEST + 1):
        holds = known.holds(keys)
        if before is not None:
            holds |= ~np.isin(places, before.get(length, ()), assume_unique=True)
        yield length, places, keys, holds
        at, of_at = places[holds], keys[holds]
        # Both parts are known: this one, and the one that begins a word later.
        follows = np.zeros(n + 1, bool)
        follows[at] = True
        both = follows[at + 1]
        both &= piece.together[np.minimum(at + length - 1, n - 1)]
        places = at[both]
        with np.errstate(over="ignore"):
            keys = _mix(of_at[both] * np.uint64(0x9E3779B97F4A7C15) + piece.hashes[np.minimum(places + length, n - 1)])
        if not len(places):
            return


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[_Piece, list[str]]]:
    """Of a batch of (lang, text)."""
    for at, texts in pieces(batch.column(1)):
        langs = batch.column(0).slice(at, len(texts)).to_pylist()
        yield _read(texts, langs), langs


def _among(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array `seen`."""
    if not len(seen):
        return np.zeros(len(keys), bool)
    return seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] == keys


def _combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, of_key = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(of_key, np.concatenate(counts), len(distinct)).astype(np.int64)


def _counted(known: BitMap, before: BitMap | None, ahead: bool):
    """Counts (level, key, n) of the known phrases and their border, without those that a pass with `before` has counted; in the
    first pass also of all words of each language, under level 0.
    `ahead`: with all longer phrases that these open, as if they were frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, tuple[list, list]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for level, (keys, counts) in gathered.items():
                distinct, n = _combined(keys, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(distinct), level, np.int8)), pa.array(distinct.view(np.int64)), pa.array(n)],
                    names=["level", "key", "n"],
                )
            gathered.clear()

        for batch in batches:
            for piece, langs in _pieces(batch):
                if before is None:
                    lists = gathered.setdefault(0, ([], []))
                    lists[0].append(np.array([_language_hash(lang) for lang in langs], np.uint64))
                    lists[1].append(np.diff(piece.first))
                done = None if before is None else {level: places for level, places, _, _ in _levels(piece, before)}
                for level, places, keys, _ in _levels(piece, known, done if ahead else None):
                    if done is not None:
                        keys = keys[~np.isin(places, done.get(level, ()), assume_unique=True)]
                    distinct, n = np.unique(keys, return_counts=True)
                    lists = gathered.setdefault(level, ([], []))
                    lists[0].append(distinct)
                    lists[1].append(n)
                    size += len(distinct)
            if size > GATHERED:
                yield from given()
                size = 0
        yield from given()

    return run


def mined(rows: DataFrame, least: int, proposed: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The frequent phrases (level, key, n) of `rows` (lang, text), with the words of each language under level 0, and how many
    passes it took. `proposed` (level, key): a
    sample's. Without it the first pass counts words only, and each further one a word more. With it failures are few, so that
    a further pass counts all that they may open at once."""
    spark = rows.sparkSession
    known_keys = proposed.select("level", "key") if proposed is not None else spark.createDataFrame([], "level tinyint, key long")
    bits = _bits_for(known_keys.count()) if proposed is not None else MOST_BITS - 2
    known, before, found = BitMap(bits), None, None
    if proposed is not None:
        known = bit_map(known_keys, bits)
    for passes in range(1, LONGEST + 2):
        counts = rows.mapInArrow(_counted(known, before, proposed is not None), "level tinyint, key long, n long")
        counts = counts.groupBy("key").agg(F.max("level").alias("level"), F.sum("n").alias("n"))
        frequent = written(counts.where((F.col("n") >= least) | (F.col("level") == 0)).select("level", "key", "n"), "phrase-counts")
        found = frequent if found is None else found.union(frequent)
        failures = frequent.where(F.col("level").between(1, LONGEST - 1)).join(known_keys.select("key"), "key", "left_anti")
        failures = written(failures.select("level", "key"), "phrase-failures")
        if failures.isEmpty() or (proposed is not None and passes > 1):
            break
        known_keys = known_keys.union(failures)
        before, known = known, bit_map(known_keys, bits)
    return found, passes


def _spelled(known: BitMap, wanted: BitMap):
    """(key, lang, words, phrase) of the known phrases that are wanted, and of languages under 0 words; a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            rows: dict[int, tuple[str, int, str]] = {}
            for piece, langs in _pieces(batch):
                for lang in set(langs):
                    key = np.array([_language_hash(lang)], np.uint64)
                    if wanted.holds(key)[0] and not _among(key, seen)[0]:
                        rows[int(key[0])] = (lang, 0, "")
                data = None
                for level, places, keys, holds in _levels(piece, known):
                    holds = holds & wanted.holds(keys)
                    distinct, firsts = np.unique(keys[holds], return_index=True)
                    new = ~_among(distinct, seen)
                    at = places[holds][firsts[new]]
                    text_of = np.searchsorted(piece.first, at, side="right") - 1
                    for key, i, text in zip(distinct[new].tolist(), at.tolist(), text_of.tolist(), strict=True):
                        data = data or piece.data.tobytes().translate(_LOWER)
                        ends = zip(piece.starts[i : i + level].tolist(), piece.ends[i : i + level].tolist(), strict=True)
                        rows[key] = (langs[text], level, b" ".join([data[x:y] for x, y in ends]).decode("utf-8", "replace"))
            new_keys = np.array(list(rows), np.uint64)
            seen = np.union1d(seen, new_keys)
            columns = zip(*rows.values(), strict=True) if rows else ([], [], [])
            kinds = (pa.string(), pa.int8(), pa.string())
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new_keys.view(np.int64)), *arrays], names=["key", "lang", "words", "phrase"])

    return run


def _bits_for(n: int) -> int:
    return min(max(LEAST_BITS, (n * BITS_EACH).bit_length()), MOST_BITS)


def spelled_out(found: DataFrame, rows: DataFrame, few: DataFrame) -> DataFrame:
    """(key, lang, words, phrase) of all keys of `found`; `few` are some of the `rows`, which most phrases occur in."""
    schema = "key long, lang string, words tinyint, phrase string"
    keys = found.select("key")
    known = bit_map(keys, _bits_for(keys.count()))
    first = few.mapInArrow(_spelled(known, known), schema)
    first = written(first.groupBy("key").agg(F.min(F.struct("lang", "words", "phrase")).alias("as")), "phrase-texts")
    missing = written(keys.join(first.select("key"), "key", "left_anti"), "phrase-missing")
    n = missing.count()
    if n:
        rest = rows.mapInArrow(_spelled(known, bit_map(missing, _bits_for(n))), schema).join(missing, "key", "left_semi")
        first = first.union(written(rest.groupBy("key").agg(F.min(F.struct("lang", "words", "phrase")).alias("as")), "phrase-texts"))
    return first.select("key", "as.*")


def frequent_phrases(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    share: float = SHARE,
) -> DataFrame:
    """All phrases of 1 to LONGEST words that occur at least `least` times in a language: lang, words, phrase, n; and with 0
    words the number of all words of each language that has any text.

    A-Z are lower-cased. Texts are cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs; phrases
    lie within a piece, overlapping occurrences count. Null texts are empty, a null language is `und`. Ids only spread the
    sample; they may be null or repeat, every row counts. Other columns are not read. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    lang = F.coalesce(documents[lang_col].cast("string"), F.lit("und")).alias("lang")
    rows = documents.select(lang, documents[text_col].alias("text"))
    place = F.pmod(F.xxhash64(documents[id_col], documents[text_col]), F.lit(1 << 20)).alias("place")
    given = documents.select(lang, documents[text_col].alias("text"), place)
    few = max(int(share * (1 << 20)), SPELLED * (1 << 20) // least)
    sample = written(given.where(F.col("place") < few), "phrase-sample")
    mining = sample.where(F.col("place") < int(share * (1 << 20))).select("lang", "text")
    proposed, _ = mined(mining, max(1, int(least * share * LOWERED)))
    found, _ = mined(rows, least, proposed.where("level > 0"))
    found = written(found, "phrase-found")
    texts = spelled_out(found, rows, sample.where(F.col("place") < SPELLED * (1 << 20) // least).select("lang", "text"))
    return written(found.join(texts, "key").select("lang", "words", "phrase", "n"), "phrases")


def collocations(frequent: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score. `frequent` as `frequent_phrases` gives it.

    Of the cuts of a phrase in two the one with the least floor(1000 * a * n / (l * r)) counts, the first of equal ones. A
    phrase goes if it lies in a longer one that occurs as often. It is enough to look one word further: what lies between
    the two in length occurs as often, too. Products are DECIMAL, exact beyond 64 bits.
    """
    of = frequent.select("lang", "phrase", "words", F.col("n").alias("a"))
    several = of.where("words > 1")
    # A language may have most of the phrases: its total goes to them by a broadcast.
    sizes = written(several.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")), "phrase-langs")
    totals = frequent.where("words = 0").select("lang", "n").join(sizes, "lang")
    several = attach(several, totals, "lang", "_rows", sizes.agg(F.sum("_rows")).first()[0] or 0)
    parts = F.split("phrase", " ")
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(parts, F.col("cut") + 1, F.col("words")), " "))
    heads = of.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = of.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
    longer = of.where("words > 2")
    inner = F.explode(
        F.array(
            F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " "),
            F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "),
        )
    )
    covered = longer.select("lang", inner.alias("phrase"), "a")
    kept = least.join(covered, ["lang", "phrase", "a"], "left_anti")
    rows = kept.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
