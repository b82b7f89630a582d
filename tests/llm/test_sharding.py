import zlib

import pytest

from donorlens.llm.sharding import kd_shards

from .common import collected, documents, table


def check(rows, got, shards):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for shard in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["shard"] for r in got} <= set(range(shards))


@pytest.mark.parametrize("shards", [8, 5])
def test_equal_bytes(spark, shards):
    rows = [(r[0], r[1]) for r in table("documents", "/root/testdata/sf0.01")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kd_shards(docs, shards=shards).collect()
    check(rows, got, shards)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) for _, t in rows)


def test_split_is_the_weighted_median(spark):
    """All texts differ: those that are equal stay together and can only be cut between."""
    rows = [(i, f"{i:04}" + "x" * (i % 50)) for i in range(2000)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = kd_shards(docs, shards=2).collect()
    check(rows, got, 2)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in (0, 1)]
    assert abs(sizes[0] - sizes[1]) <= 100
    assert max(r["size"] for r in got if r["shard"] == 0) <= min(r["size"] for r in got if r["shard"] == 1)


def test_target_bytes_and_edges(spark):
    rows = [(i, "same") for i in range(100)] + [(1000, None), (1001, ""), (1002, "y" * 300)]
    got = kd_shards(documents(spark, rows), target_bytes=100).collect()
    check(rows, got, 9)
    assert collected(kd_shards(documents(spark, []), shards=8)) == []
    few = kd_shards(documents(spark, [(None, "a"), (None, "a"), (1, None)]), shards=8).collect()
    assert len(few) == 3


def test_equal_texts_stay_together(spark):
    """Copies differ in lang and source; a group that is too heavy for one shard is divided."""
    rows = [(i, f"text {i % 700} " + "y" * 40, f"l{i % 3}", f"s{i % 11}", 50) for i in range(2100)]
    rows += [(9000 + i, "z" * 60, "l1", "s1", 60) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = kd_shards(docs, shards=8).collect()
    check([(r[0], r[1]) for r in rows], got, 8)
    text = {r[0]: r[1] for r in rows}
    shards = {}
    for r in got:
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in shards.items() if t[0] == "t") and len(shards["z" * 60]) > 1
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sizes) <= 1.1 * min(sizes)


def placed(rows):
    """What rows have in place of their texts: the number of the text among the distinct ones, nulls first."""
    order = {t: i for i, t in enumerate(sorted({r[3] for r in rows if r[3] is not None}, key=str.encode), 1)}
    return [order.get(r[3], 0) for r in rows]


def test_texts_with_a_common_beginning_are_cut_by_their_order(spark):
    """One dimension: every shard holds a run of the sources in order, cut next to the weighted medians of the sorted rows."""
    sources = [f"https://{c}{i}.example.org/" for c in "azm" for i in range(40)]
    rows = [(i, f"text {i} " + "w" * (i * 7 % 90), None, sources[i * i % 120] if i % 50 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards(docs, shards=4, dims=("source",)).collect()
    check([(r[0], r[1]) for r in rows], got, 4)
    place, shard = dict(zip([r[0] for r in rows], placed(rows))), {r["doc_id"]: r["shard"] for r in got}
    size = {r["doc_id"]: r["size"] for r in got}
    by_place = sorted(place, key=place.get)
    total, before = sum(size.values()), 0
    per_place = {}
    for i in by_place:
        per_place[place[i]] = per_place.get(place[i], 0) + size[i]
    for i in by_place:
        assert abs(shard[i] - min(3, 4 * before // total)) <= 1
        before += size[i]
    ends = [sum(size[i] for i in place if shard[i] <= k) for k in range(3)]
    for k, end in enumerate(ends):
        assert abs(end - total * (k + 1) / 4) <= total / 4000 * 4 + 100
    runs = [sorted({place[i] for i in place if shard[i] == k}) for k in range(4)]
    assert all(a[-1] <= b[0] for a, b in zip(runs, runs[1:]))


def test_groups_lighter_than_a_shard_stay_whole(spark):
    """A group of a twentieth of a shard, one of nine tenths, and a very long text."""
    rows = [(i, f"{i} " + "x" * 46) for i in range(1600)]
    rows += [(5000 + i, "g" * 49) for i in range(10)] + [(6000 + i, "h" * 49) for i in range(180)] + [(9000, "y" * 300_000)]
    got = kd_shards(documents(spark, rows), shards=8).collect()
    check(rows, got, 8)
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert len({shard[i] for i in range(5000, 5010)}) == 1 and len({shard[i] for i in range(6000, 6180)}) == 1


def test_a_cut_lies_at_the_nearer_edge_of_a_group(spark):
    """Forty copies of each of fifty texts: the cut next to the median that divides no group."""
    rows = [(i, "x" * (i % 50)) for i in range(2000)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = kd_shards(docs, shards=2).collect()
    check(rows, got, 2)
    before = [40 * k * (k + 1) // 2 for k in range(51)]
    nearest = min(before, key=lambda b: abs(b - before[-1] / 2))
    assert sum(r["size"] for r in got if r["shard"] == 0) == nearest
