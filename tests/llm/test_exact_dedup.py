from pyspark.sql import functions as F

from donorlens.llm.exact_dedup import exact_dedup

from .common import collected, documents

ROWS = [(1, "Same"), (2, "same"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "same"), (2, "SAME"), (7, "x" * 200_000)]


def expected(rows):
    groups = {}
    for i, text in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(key, []).append(i)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first))
            first = first and i != keep
    return sorted(out, key=str)


def test_groups_nulls_repeats(spark):
    got = exact_dedup(documents(spark, ROWS)).drop("text_sha256")
    assert sorted(collected(got), key=str) == expected(ROWS)


def test_colliding_digests_are_told_apart_by_content(spark):
    for digest in (F.length, lambda c: F.lit("one")):
        got = exact_dedup(documents(spark, ROWS), digest=digest).drop("text_sha256")
        assert sorted(collected(got), key=str) == expected(ROWS)


def test_hot_group(spark):
    rows = [(i, "hot") for i in range(500)] + [(1000 + i, f"text {i // 2}") for i in range(4000)]
    got = exact_dedup(documents(spark, rows).repartition(7), salts=3).drop("text_sha256")
    assert sorted(collected(got), key=str) == expected(rows)


def test_empty(spark):
    assert collected(exact_dedup(documents(spark, []))) == []
