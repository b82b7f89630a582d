"""Spans against the plain patterns of the contract."""

import hashlib
import random
import re
import time

from donorlens.llm.secret_scan import checksum62, find_secrets, scan

from .common import collected, documents, table

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            size, least = (len(m[2]), 8) if kind == "assign" else (len(m[0]), 16 if kind == "access" else 32)
            if size >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_documents():
    for _, text, *_ in table("documents", "/root/testdata/sf0.01"):
        assert [s for s in scan(text) if s[0] != "checked"] == brute(text)


def test_random_texts():
    rng = random.Random(2)
    parts = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", "AKIA", "ſ", "K", "İ", "é", "😀", "=", ":", " ", '"', "'", "abcdef0123456789", "A1B2C3D4E5F6", "x", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert [s for s in scan(text) if s[0] != "checked"] == brute(text), text


def test_checksum_tokens():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"ghp_{body}{checksum62(body)}"
    assert scan(f"é {good}") == [("checked", 2, 2 + len(good))]
    assert scan(f"ghp_{body}000000") == []


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "é token = 0123456789"), (4, "f" * 500_000), (None, "AKIA" + "Z" * 16), (3, "é token = 0123456789")]
    got = {r["spans"]: r for r in find_secrets(documents(spark, rows)).collect()}
    assert set(got) == {"", "assign:2:20", "hex:0:500000", "access:0:20"}
    r = got["assign:2:20"]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 0, 0)
    assert r["base_sha256"] == hashlib.sha256(b"assign:2:20").hexdigest()
    assert collected(find_secrets(documents(spark, []))) == []


def test_many_runs_take_linear_time():
    text = "é" + ("a1" * 16 + "é ") * 16_000
    begin = time.perf_counter()
    found = scan(text)
    assert time.perf_counter() - begin < 0.5
    assert [s[1:] for s in found] == [(1 + 34 * i, 33 + 34 * i) for i in range(16_000)]
