import random

import numpy as np
import pytest

from donorlens.llm import decontaminate
from donorlens.llm.decontaminate import clean, contaminated, lcs

from .common import SF_DIR, collected, documents


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(500):
        a, b = (rng.choices(range(6), k=rng.randrange(1, 25)) for _ in range(2))
        assert lcs(a, b) == slow_lcs(a, b)


def planted():
    """Items, and documents that hold them as they are, in capitals, with changed words, and not at all."""
    rng = random.Random(8)
    common = [f"the{i}" for i in range(30)]
    rare = [f"word{i}" for i in range(4000)]
    sentence = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(i, " ".join(sentence(n - 6)) + ". " + " ".join(sentence(6)) + ".") for i, n in enumerate([14, 25, 40, 55])]
    docs, want = [], set()
    for i in range(400):
        text = sentence(rng.randrange(20, 400))
        if i % 4 == 0:
            item, words = items[i // 4 % 4][0], items[i // 4 % 4][1].split()
            if i % 12 == 0:
                words = [w.upper() for w in words]
            elif i % 12 == 4:
                words = [w if rng.random() < 0.85 else rng.choice(rare) for w in words]
            at = rng.randrange(len(text))
            text[at:at] = words
            want.add((i, item))
        docs.append((i, " ".join(text)))
    return docs, items, want


def test_planted(spark):
    docs, items, want = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs).repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame, benchmark).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    kept = clean(frame, benchmark)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_short_items_at_all_offsets(spark):
    """Items of 3 to 14 words that the documents know, between words of twice their weight and more."""
    known = {n: [f"known{n}w{k}" for k in range(n)] for n in range(3, 15)}
    docs, want = [], set()
    for n, item in known.items():
        for offset in range(16):
            i = len(docs)
            foreign = [f"d{i}w{k}" for k in range(60)]
            docs.append((i, " ".join([*foreign[: offset + 8 * (offset % 3)], *item, *foreign[30:]])))
            want.add((i, n))
    # The words of an item far apart make it more common, but are not the item.
    for n, item in known.items():
        for _ in range(12):
            i = len(docs)
            docs.append((i, " ".join(w for k, word in enumerate(item) for w in [word, *(f"d{i}w{k}x{j}" for j in range(150))])))
    docs += [(len(docs) + i, " ".join(f"f{i}w{k}" for k in range(50))) for i in range(400)]
    benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in known.items()], "item_id long, text string")
    frame = documents(spark, docs).repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame, benchmark).collect()}
    assert got == want
    assert {r["doc_id"] for r in clean(frame, benchmark).collect()} == {i for i, _ in docs} - {i for i, _ in want}


@pytest.mark.parametrize("sample_docs", [4000, 40])
def test_recall_against_brute_force_on_documents(spark, monkeypatch, sample_docs):
    """Every place of every text against every item, by the same judgement; with all documents in the fit, and with a fifth."""
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCS", sample_docs)
    docs, benchmark = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()}
    split = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    want = set()
    for d in docs.collect():
        text = split(d["text"])
        for b in benchmark.collect():
            item = split(b["text"])
            if len(set(item) & set(text)) >= 0.75 * len(set(item)):
                spans = (text[at : at + 3 * len(item)] for at in range(0, len(text), len(item)))
                if any(slow_lcs(item, s) >= 0.75 * len(item) for s in spans):
                    want.add((d["doc_id"], b["item_id"]))
    assert want and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)


def test_edges(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "x " * 60_000), (5, "short item"), (6, "item short")]
    docs = documents(spark, rows)
    benchmark = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "Short item!", "x")], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()), key=str)
    assert got == sorted([(3, 1), (3, 1), (None, 1), (5, None)], key=str)
    assert sorted(r["doc_id"] for r in clean(docs, benchmark).collect()) == [1, 2, 4, 6]
    assert collected(contaminated(documents(spark, []), benchmark)) == []
    assert collected(contaminated(docs, benchmark.limit(0))) == []
    assert clean(docs, benchmark.limit(0)).count() == 8


def test_sums_of_groups():
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((50, 7)).astype(np.float32)
    groups = np.sort(rng.choice([0, 1, 1, 1, 4, 5, 5, 9], 20_000))
    rows, weights = rng.integers(0, 50, len(groups)), rng.random(len(groups)).astype(np.float32)
    want = np.zeros((11, 7))
    np.add.at(want, groups, weights[:, None] * matrix[rows])
    assert np.allclose(decontaminate._sums(weights, rows, matrix, groups, 11), want, rtol=1e-3)
    assert not decontaminate._sums(weights[:0], rows[:0], matrix, groups[:0], 3).any()
