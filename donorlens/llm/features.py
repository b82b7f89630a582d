"""Words and hashes of whole Arrow batches of texts with numpy, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space of the contracts: the space and the bytes 9 to 13. UTF-8 uses these bytes for nothing else.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII that is no letter or digit.
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte value, so that sums over bytes have no structure of their own.
_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = 2 << 20):
    """Cut a column into runs of rows of at most `most` bytes (or one row), to bound the memory of what follows."""
    lengths = np.diff(buffers(texts)[1])
    at = 0
    while at < len(texts):
        end, size = at + 1, lengths[at]
        while end < len(texts) and size + lengths[end] <= most:
            size += lengths[end]
            end += 1
        yield at, texts.slice(at, end - at)
        at = end


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (in bytes), 64-bit hash, and first word of each text (one more entry than texts).

    Words are runs of other bytes than those `between` them (white space), A-Z lower-cased. A hash is a polynomial in an odd number over
    random numbers for the bytes, modulo 2^64, taken as a difference of running sums.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    solid = ~between[data]
    begins = np.zeros(len(data) + 1, bool)  # where a text begins, a word can't go on
    begins[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | begins[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | begins[1:])) + 1
    hashes = _substrings(data, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


#: Powers of the base and of its inverse, for running sums in blocks of this many bytes.
_BLOCK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x5851F42D4C957F2D
_UP = _powers(_BASE)
_DOWN = _powers(pow(_BASE, -1, 1 << 64))


def _substrings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each substring: the sum of (number of byte) x base^(place in the substring)."""
    up = np.resize(_UP, len(data)) if len(data) > _BLOCK else _UP[: len(data)]
    # Places count from the start of a block; a substring that crosses blocks is shifted by what powers wrap.
    terms = _OF_BYTE[data] * up
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    out = (sums[ends] - sums[starts]) * _DOWN[starts % _BLOCK]
    crossing = np.flatnonzero(starts // _BLOCK != (ends - 1) // _BLOCK)
    for i in crossing:
        part = _OF_BYTE[data[starts[i] : ends[i]]]
        total, scale = 0, 1
        for at in range(0, len(part), _BLOCK):
            block = part[at : at + _BLOCK]
            total += int(np.sum(block * _UP[: len(block)], dtype=np.uint64)) * scale
            scale = scale * int(_UP[-1]) * _BASE % (1 << 64)
        out[i] = total % (1 << 64)
    return _mix(out + (ends - starts).astype(np.uint64) * _ODD)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words inside each text, and the first run of each text (one more entry than texts).

    A text of fewer words, but not of none, has its whole sequence as its only run.
    """
    n_words = np.diff(first)
    n_runs = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n_runs)])
    text_of = np.repeat(np.arange(len(n_words)), n_runs)
    place = first[:-1][text_of] + np.arange(at[-1]) - at[:-1][text_of]
    out = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        scale = np.uint64(1)
        for k in range(size):
            scale = scale * np.uint64(0xD1342543DE82EF95)
            here = place + k < first[1:][text_of]
            out += np.where(here, hashes[np.minimum(place + k, len(hashes) - 1)] if len(hashes) else 0, np.uint64(0)) * scale
        out = _mix(out + np.minimum(n_words, size).astype(np.uint64)[text_of])
    return out, at
