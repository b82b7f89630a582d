"""Components against brute force: every pair that shares a shingle."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from donorlens.llm import ngram_join
from donorlens.llm.features import buffers, shingles, words
from donorlens.llm.ngram_join import needed, ngram_components, prefix_sizes, similar

from .common import SF_DIR, collected, documents, table


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    shared = defaultdict(int)
    for members in holders.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                shared[members[a], members[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows):
    return sorted(collected(ngram_components(documents(spark, rows)).drop("text_copies")), key=str)


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_documents(spark, sf_dir):
    rows = [(r[0], r[1]) for r in table("documents", sf_dir)]
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e")]
    rows += [(None, "a b c d e"), (9, "x " * 50_000), (10, "X\v" * 40_000), (11, "é É"), (12, "É É"), (None, "own words"), (13, "a b c d e f")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_large_groups_with_drift(spark, monkeypatch):
    """A chain of small changes, whose far ends share little, and many near copies of one text."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=120)
    rows, text = [], list(base)
    for i in range(60):
        text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(text)))
    for i in range(60):
        near = list(base)
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append((2000 + i, " ".join(near)))
    rows += [(3000 + i, " ".join(base[:60] + rng.choices(vocabulary, k=60))) for i in range(40)]
    assert got(spark, rows) == brute(rows)


def test_batch_of_texts_gives_the_sets_of_single_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(["ab ", "c", "\n", "Zé", " "], k=rng.randrange(40))) for _ in range(300)] + ["", None, "q " * 70_000, "long" * 40_000]
    array = pa.array(texts, pa.string())
    data, offsets = buffers(array)
    _, _, hashes, first = words(data, offsets)
    runs, at = shingles(hashes, first, 5)
    names = {}
    for i, text in enumerate(texts):
        found = set(runs[at[i] : at[i + 1]].tolist())
        plain = shingle_set(text)
        assert len(found) == len(plain)
        alone = list(ngram_join._sets(pa.array([text], pa.string())))[0]
        assert set(alone.tolist()) == found
        assert names.setdefault(frozenset(found), frozenset(plain)) == plain


def test_bounds():
    for n in range(1, 200):
        probe, index = prefix_sizes(n)
        assert 1 <= index <= probe <= n
        for m in range(n, 270):
            alpha = needed(n, m)
            assert 100 * alpha >= 75 * (n + m - alpha) and 100 * (alpha - 1) < 75 * (n + m - alpha + 1)
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        x, y = (np.sort(rng.choice(pool, rng.integers(40, 58), replace=False)) for _ in range(2))
        n = len(np.intersect1d(x, y))
        assert similar(x, y) == (100 * n >= 75 * (len(x) + len(y) - n))


def test_large_groups_of_unlike_sets_take_seconds():
    """Thousands of sets that share a rare shingle and nothing else: all are compared, and no pair is left."""
    rng = np.random.default_rng(5)
    rows = np.zeros(4000, ngram_join.MEMBER)
    rows["entity"], rows["n"], rows["place"] = np.arange(1, 4001), rng.integers(60, 80, 4000), rng.integers(0, 5, 4000)
    rows["signature"] = rng.integers(0, 1 << 63, (4000, 16)).astype(np.uint64)
    group = ngram_join._Group(rows)
    begin = time.perf_counter()
    assert not any(len(group.near(i, np.arange(i))[0]) for i in range(4000))
    assert time.perf_counter() - begin < 10
