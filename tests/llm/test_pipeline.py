import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from donorlens.llm import ngram_join, quality
from donorlens.llm.decontaminate import contaminated
from donorlens.llm.store import summed_vectors, written

from .common import SF_DIR, documents
from .test_ngram_join import brute


def test_stages_against_the_operators(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels, benchmark = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    good = stages["quality classifier"](spark, docs, SF_DIR).cache()
    scored = quality.score(docs, quality.fit(docs, labels))
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in scored.where("predicted = 1").collect())
    one = stages["n-gram Jaccard join"](spark, good, SF_DIR).cache()
    want = sorted(i for i, n, component in brute([(r["doc_id"], r["text"]) for r in good.collect()]) if i == component)
    assert sorted(r["doc_id"] for r in one.collect()) == want
    clean = stages["benchmark decontamination"](spark, one, SF_DIR).cache()
    leaks = {r["doc_id"] for r in contaminated(one, benchmark).collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(want) - leaks
    mixed = stages["mixing sources"](spark, clean, SF_DIR)
    assert good.columns == one.columns == clean.columns == mixed.columns == docs.columns
    assert mixed.schema == docs.schema
    shards = stages["sharding"](spark, mixed, SF_DIR)
    assert shards.count() == mixed.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns[0] == "doc_id"


def test_representatives_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (2, "a b c d e f"), (3, None), (3, ""), (None, "x y z"), (None, "x y z")]
    kept = ngram_join.representatives(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "other words"), (3, None), (3, ""), (None, "x y z")], key=str)


def test_stages_take_nulls_empty_tables_and_any_column(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, and columns that are named like the operators' own."""
    names = ["_set", "_key", "_kept", "_copy", "_label", "n", "name", "leaf", "key", "shard", "size", "token", "taken", "epoch"]
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", None, 11), (2, "", None, "src1", 0), (2, "", None, "src1", 0)]
    rows += [(3, "word " * 30_000, "de", "src2", 150_000), (4, "x", "de", "src2", 1), (5, "some plain words of text here", "en", "src0", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    own = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)
    for table in (own, own.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, SF_DIR)
            assert got.columns == own.columns, name
            ids = {r["doc_id"] for r in got.collect()}
            assert ids <= {1, 2, 3, 4, 5, None} and (table is own or not ids), name
        shards = corpus_pipeline.STAGES[-1][1](spark, table, SF_DIR)
        assert shards.count() == table.count()


@pytest.mark.parametrize("step", ["a table", "a vector"])
def test_driver_gives_freed_memory_back(spark, step):
    """Many small pieces that the JVM has freed between others don't stay with it."""
    one = np.ones(4, "int32").tobytes()
    vectors = spark.createDataFrame([(bytearray(one),)], "v binary")
    run = {"a table": lambda: written(vectors, "test-freed"), "a vector": lambda: summed_vectors(vectors, 4)}[step]
    run()
    native, page = spark._jvm.org.apache.spark.unsafe.Platform, 1 << 16
    pieces = [native.allocateMemory(page) for _ in range(2000)]
    try:
        for piece in pieces[1:]:
            native.copyMemory(None, pieces[0], None, piece, page)
        kept, freed = pieces[::50], [p for k, p in enumerate(pieces) if k % 50]
        pieces = kept
        for piece in freed:
            native.freeMemory(piece)
        status = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
        held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", status.read_text())[1]) / 1024
        before = held()
        run()
        assert held() < before - 60
    finally:
        for piece in pieces:
            native.freeMemory(piece)
