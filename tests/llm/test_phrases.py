import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlens.llm import phrases

SCHEMA = "doc_id long, text string, lang string, level int, key long, n long, phrase string, words int, a string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "p", 4, "a") for r in rows], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, totals


def expected(rows, least, top):
    counts, totals = counted(rows)
    frequent = {key: n for key, n in counts.items() if n >= least}
    out = []
    for lang in totals:
        own = {w: n for (of, w), n in frequent.items() if of == lang}
        found = []
        for words, a in own.items():
            if len(words) == 1:
                continue
            longer = [w for w, n in own.items() if len(w) > len(words) and n >= a]
            if any(w[i : i + len(words)] == words for w in longer for i in range(len(w) - len(words) + 1)):
                continue
            cuts = [(1000 * a * totals[lang] // (own[words[:k]] * own[words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(words).encode(), own[words[:k]], own[words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "É", "x-y", "z"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ", ", "\n", "!", " "]) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            text += " the Quick  brown fox jumps over"
        rows.append((i, text, rng.choice(["en", "de", None])))
    return rows + [(None, None, "en"), (1, "", "fr"), (2, " . ", None), (3, "a b " * 5000, "en")] + [(7, "same words here", "es")] * 60


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_matches_plain_counting_whatever_the_sample_has(spark, share):
    rows = some_rows(300)
    frequent = phrases.frequent_phrases(table(spark, rows).repartition(5), least=20, share=share)
    assert sorted(tuple(r) for r in phrases.collocations(frequent, top=40).collect()) == expected(rows, 20, 40)
    counts, totals = counted(rows)
    plain = {(lang, len(w), " ".join(w), n) for (lang, w), n in counts.items() if n >= 20}
    got = {tuple(r) for r in frequent.where("words > 0").collect()}
    assert got == plain
    assert {r["lang"]: r["n"] for r in frequent.where("words = 0").collect()} == dict(totals)


def test_failures_of_the_border_lead_to_further_passes(spark):
    rows = table(spark, some_rows(200)).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    everything, passes = phrases.mined(rows, 20)
    assert passes == 5
    same, passes = phrases.mined(rows, 20, everything)
    assert passes == 1 and sorted(same.collect()) == sorted(everything.collect())
    some, passes = phrases.mined(rows, 20, everything.where("level = 1"))
    assert passes == 2 and sorted(some.collect()) == sorted(everything.collect())


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    rows = [("en", 0, "", big * 9), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3)]
    frequent = spark.createDataFrame(rows, "lang string, words tinyint, phrase string, n long")
    got = phrases.collocations(frequent).first()
    assert got["score"] == 1000 * (big - 3) * big * 9 // (big * (big - 1))


def test_maps_never_lose_a_key(spark):
    keys = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, 12345678901234567] + [random.Random(2).getrandbits(64) - (1 << 63) for _ in range(3000)]
    held = phrases.bit_map(spark.createDataFrame([(k,) for k in keys], "key long"), 20)
    assert held.holds(np.array(keys, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert held.holds(others).mean() < 0.01


def test_empty(spark):
    assert phrases.collocations(phrases.frequent_phrases(table(spark, []))).collect() == []
