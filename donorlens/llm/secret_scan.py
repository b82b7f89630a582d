"""Secrets: an Aho-Corasick automaton finds keywords, anchored regular expressions run only where it hits, and tokens that
embed a checksum are held against it.

Runs of hexadecimal digits have no keyword; they are found by differences over the text's bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of the contract, in its order.
BASE_KINDS = ("assign", "access", "hex")
#: Tokens that end in a checksum: six base-62 digits of the CRC-32 of the thirty characters before.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KINDS = (*BASE_KINDS, "checked")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:%s)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])" % "|".join(CHECKED_PREFIXES))
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCHEMA = (
    "doc_id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
)


@cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        automaton.add_word(word, (len(word), "assign"))
    for word, kind in (("akia", "access"), *((p, "checked") for p in CHECKED_PREFIXES)):
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def checksum62(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


_HEX = np.zeros(256, np.int8)
_HEX[list(b"0123456789abcdef")] = 1


def _hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte places of the runs of at least MIN_HEX hexadecimal digits."""
    edges = np.diff(_HEX[np.frombuffer(raw, np.uint8)], prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= MIN_HEX
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each span, by start and then by kind as listed; positions count code points."""
    if not text:
        return []
    raw = text.encode()
    found = []
    runs = _hex_runs(raw)
    if runs and len(raw) != len(text):
        # A run is ASCII; only what stands before it can make places of bytes and of code points differ.
        begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64)
        runs = [(int(begun[start]) - 1, int(begun[start]) - 1 + end - start) for start, end in runs]
    found += [("hex", start, end) for start, end in runs]
    # Lower-casing bytes touches A-Z alone and so keeps every place.
    hits = [(end + 1 - size, kind) for end, (size, kind) in _automaton().iter(raw.lower().decode())]
    free = {"assign": 0, "access": 0, "checked": 0}
    for start, kind in sorted(set(hits)):
        if start < free[kind]:
            continue
        match = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
        if not match:
            continue
        free[kind] = match.end()
        if (
            len(match.group(1)) >= MIN_VALUE
            if kind == "assign"
            else match.end() - start >= MIN_ACCESS
            if kind == "access"
            else checksum62(match.group(1)) == match.group(2)
        ):
            found.append((kind, start, match.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for batch in batches:
        spans = [scan(text) for text in batch.column(1).to_pylist()]
        count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in spans], pa.int64())  # noqa: B023, E731
        base = [join(s for s in x if s[0] in BASE_KINDS) for x in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(count(kind) for kind in BASE_KINDS),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([join(x) for x in spans], pa.string()),
                count("checked"),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
        )


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts per kind, the digest of the base spans, and all spans as text.

    `spans` lists kind:start:end by start, then kind; positions count code points, the end is exclusive. A null or empty
    text has no spans. Ids may be null or repeat: each row stands for itself. Other columns are not read. An empty table
    gives an empty result. Kinds are searched independently, so their spans may overlap.
    """
    schema = SCHEMA.format(id=df.schema[id_col].dataType.simpleString())
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(_digested, schema)
