"""Spans against the plain patterns of the contract in Python's `re`."""

import hashlib
import random
import re

from donorlens.llm.pii import find_pii, luhn, mod97, pii_digest
from pyspark.sql import functions as F

from .common import SF_DIR, collected, documents, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and passes_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), m.end()))
        out[kind] = spans
    return out


def check(spark, rows):
    found = find_pii(documents(spark, rows))
    digests = {r["doc_id"]: r for r in pii_digest(found).collect()}
    for row in found.collect():
        want = brute(dict(rows)[row["doc_id"]])
        assert {k: [(s["start"], s["end"]) for s in row[k]] for k in PATTERNS} == want, row["doc_id"]
        base = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k])
        digest = digests[row["doc_id"]]
        assert digest["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert digest["spans"].startswith(base)
        assert [digest[f"n_{k}"] for k in PATTERNS] == [len(v) for v in want.values()]


def test_matches_plain_patterns_on_documents(spark):
    for sf_dir in (SF_DIR, "/root/testdata/sf0.01"):
        check(spark, [(r[0], r[1]) for r in table("documents", sf_dir)])


def test_random_texts(spark):
    rng = random.Random(5)
    pieces = ["a", "b@", "@", ".c", "_", "-", " ", "+", "1", "22", "333", ".4", "4111 1111 1111 1111", "1.2.3.4", "+49 (30) 12", "é", "😀", "0", "x@y.z", "\n"]
    check(spark, [(i, "".join(rng.choices(pieces, k=rng.randrange(60)))) for i in range(3000)])


def test_edges(spark):
    rows = [(0, None), (1, ""), (7, "0001.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8"), (8, "a@b.c_d@e.f"), (9, "1 2-" * 500)]
    check(spark, rows + [(6, "x@y.zz " * 3_000)])
    assert collected(find_pii(documents(spark, []))) == []


def test_long_runs_take_linear_time(spark):
    rows = [(2, "a" * 300_000), (3, "1" * 300_000), (5, "+1" + " " * 200_000), (9, "1 2-" * 50_000)]
    assert {r["spans"] for r in pii_digest(find_pii(documents(spark, rows))).collect()} == {""}
    dotted = pii_digest(find_pii(documents(spark, [(4, "1." * 100_000)]))).first()
    assert dotted["n_ip"] == 25_000 and dotted["spans"].endswith("ip:199992:199999")


def test_added_kinds(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00, DE88370400440532013000"), (2, "ssn 123-45-6789"), (3, "part 123-45-6789")]
    spans = {r["doc_id"]: r["spans"] for r in pii_digest(find_pii(documents(spark, rows))).collect()}
    assert spans[1].split(",")[-1] == "iban:5:32"
    assert spans[2] == "ssn:4:15" and spans[3] == ""


def test_ibans_before_capitals_and_digits(spark):
    spaced, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    behind = ["", ".", " Please", " I think", " NOW", " 12 times", " 2024-01-01", "\nThe", " \U0001f600", " DE88 3704 0044 0532 0130 00"]
    rows = [(2 * i + k, f"\u00e9 {iban}{b}") for i, b in enumerate(behind) for k, iban in enumerate((spaced, plain))]
    wrong = [f"{plain}The", f"{plain}1 Please", f"X{plain} Please", "DE88 3704 0044 0532 0130 00 Please", "DE89 3704 0044 0532 0130 Please"]
    rows += [(100 + i, w) for i, w in enumerate(wrong)]
    # A beginning of another one before it, two side by side, and a code without a known length.
    rows += [(200, f"AB12 CODE {spaced} The"), (201, f"{plain} GB82 WEST 1234 5698 7654 32 Or"), (202, "ZZ33 WEST 1234 5698 7654 32 Or")]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["iban"]] for r in find_pii(documents(spark, rows)).collect()}
    for i in range(2 * len(behind)):
        assert got[i] == [(2, 2 + len(plain if i % 2 else spaced))], rows[i]
    assert [got[100 + i] for i in range(len(wrong))] == [[]] * len(wrong)
    assert got[200] == [(10, 37)] and got[201] == [(0, 22), (23, 50)] and got[202] == [(0, 27)]


def test_iban_context_ends_at_the_next_one(spark):
    iban = "DE89370400440532013000"
    rows = [(1, f"{iban} Please, my bank"), (2, f"{iban} Or {iban} my bank"), (3, f"{iban} Please")]
    got = {r["doc_id"]: [s["score"] for s in r["iban"]] for r in find_pii(documents(spark, rows)).collect()}
    assert got == {1: [1.0], 2: [0.7, 1.0], 3: [0.7]}


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB82WEST12345698765433")], "c string, i string")
    assert collected(df.select(luhn(F.col("c")), mod97(F.col("i")))) == [(True, True), (False, False)]
