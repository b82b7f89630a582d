from donorlens.llm.mixing import leaf_budgets, mix, mixed_rows

from .common import collected, documents


def budgets(spark, leaves, budget, weights, epochs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    return {r["source"]: r["budget"] for r in leaf_budgets(df, F.lit(budget), weights, epochs).collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "d", 1000)]
    # d0 and d1 get 200 each; d0's languages 100 each; a can give 10, so its sibling b gives 90.
    assert budgets(spark, leaves, 400, {}, 1) == {"a": 10, "b": 90, "c": 100, "d": 200}
    # What b can't give either goes to the language's sibling c, and nothing to d1.
    leaves[1] = ("d0", "en", "b", 20)
    assert budgets(spark, leaves, 400, {}, 1) == {"a": 10, "b": 20, "c": 170, "d": 200}
    assert budgets(spark, leaves, 400, {}, 2) == {"a": 20, "b": 40, "c": 140, "d": 200}
    assert budgets(spark, leaves, 10**6, {}, 1) == {"a": 10, "b": 20, "c": 1000, "d": 1000}
    assert budgets(spark, leaves, 400, {"domain": {"d1": 3}}, 1) == {"a": 10, "b": 20, "c": 70, "d": 300}


def test_prefix_and_epochs(spark):
    rows = [(i, "w " * (1 + i % 7)) for i in range(300)]
    docs = documents(spark, rows)
    got = mix(docs, {}, share=1.5).collect()
    tokens = sum(r["n_tokens"] for r in got)
    supply = sum(1 + i % 7 for i in range(300))
    assert supply * 1.5 <= tokens < supply * 1.5 + 7
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == set(range(300))
    again = mixed_rows(docs, {}, share=1.5)
    assert again.columns == docs.columns
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "x " * 100_000), (3, "x " * 100_000)]
    assert len(mix(documents(spark, rows), {}, share=1.0).collect()) == 6
    assert collected(mix(documents(spark, []), {})) == []
    assert collected(mixed_rows(documents(spark, []), {})) == []
    docs = spark.createDataFrame([(1, "a", None, None)], "doc_id long, text string, lang string, source string")
    assert collected(mix(docs, {}, share=1.0)) == [(1, "other", "none", "none", 1, 0)]
