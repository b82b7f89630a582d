import hashlib
import math

import numpy as np
import pytest

from donorlens.llm import anchors
from donorlens.llm.vector_codes import compress

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _label string, vector int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)


def nearest(part, entries):
    squares = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in entries]
    return squares.index(min(squares)), min(squares)


def expected(rows, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    size = len(ints[0]) // 16
    parts = [[v[p * size : (p + 1) * size] for v in ints] for p in range(16)]
    books = [list(part[:entries]) for part in parts]
    for _ in range(rounds):
        for p in range(16):
            groups = {}
            for part in parts[p]:
                groups.setdefault(nearest(part, books[p])[0], []).append(part)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    chosen = [[nearest(parts[p][i], books[p]) for p in range(16)] for i in range(len(kept))]
    errors = [sum(d for _, d in c) for c in chosen]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for e, _ in c), error, by_label[r[2]], sha) for r, c, error in zip(kept, chosen, errors)]


def some_rows(n, dims=32, seed=3):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(0, 0.1, (n, dims)), 2).astype(np.float32)
    return [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(values)]


def test_matches_plain_k_means_with_nulls_ties_and_repeats(spark):
    rows = some_rows(400)
    rows += [(i, rows[0][1], 1) for i in range(1000, 1200)] + [rows[3], rows[3], (None, rows[5][1], None)]
    bad = [(7000, None, 1), (7001, [float("nan")] * 32, 1), (7002, [1.0] * 31 + [None], 1), (7003, [float("-inf")] * 32, 1)]
    got = [tuple(r) for r in compress(table(spark, rows + bad).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_fewer_vectors_than_entries_and_equal_ones(spark):
    for rows in (some_rows(9), [(i, [0.5] * 16, 1) for i in range(70)], some_rows(1, 16)):
        got = [tuple(r) for r in compress(table(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_other_lengths_and_empty_tables(spark):
    rows = some_rows(5)
    got = {r["vec_id"]: tuple(r)[1:4] for r in compress(table(spark, rows + [(90, [], 8), (91, [1.0] * 16, 9)])).collect()}
    assert got[90] == got[91] == (None, None, None) and len(got) == 7
    assert compress(table(spark, [])).collect() == []
    assert [tuple(r) for r in compress(table(spark, [(1, [], 2)])).collect()] == [(1, None, None, None, None)]


@pytest.mark.parametrize("spread", [3, 1000, 1 << 25])
def test_trees_agree_with_all_distances(spread):
    rng = np.random.default_rng(5)
    for n in (1, 2, 65, 700, 3000):
        middle = rng.integers(-spread, spread, (8, 4))
        points = (middle[rng.integers(0, 8, n)] + rng.integers(-spread // 3 - 1, spread // 3 + 1, (n, 4))).astype(np.int32)
        points[: n // 3] = points[0]
        entries = points[rng.integers(0, n, 40)].astype(np.int64)
        tree = anchors.build(points)
        squares = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
        chosen = squares.argmin(1)
        assert (anchors.assigned(tree, points, entries) == chosen).all()
        sums, counts = anchors.entry_sums(tree, points, entries)
        assert (counts == np.bincount(chosen, minlength=40)).all()
        assert (sums == np.stack([points[chosen == e].astype(np.int64).sum(0) for e in range(40)])).all()
        assert sorted(tree.order.tolist()) == list(range(n))
        for low, high, center, radius in zip(tree.low, tree.high, tree.centers, tree.radii):
            assert (((points[tree.order[low:high]] - center) ** 2).sum(1) <= radius**2).all()


def test_balls_are_owned_as_a_whole():
    rng = np.random.default_rng(6)
    middle = rng.integers(-5000, 5000, (20, 4))
    points = (middle[rng.integers(0, 20, 4000)] + rng.integers(-20, 20, (4000, 4))).astype(np.int32)
    _, _, places, _ = anchors.owners(anchors.build(points), points, middle)
    assert len(places) < 400


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="components must lie within"):
        compress(table(spark, [(1, [1e9] * 16, 1)])).collect()
