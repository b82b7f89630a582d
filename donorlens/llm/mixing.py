"""Mixing to target weights by hierarchical budgeting over a tree of domain, language and source.

A budget of tokens flows from the root to the leaves by weight. A node never gets more than its leaves can give in
`max_epochs` passes, so what a child lacks goes to its siblings, and only what a whole subtree lacks goes to the siblings
of its root. Each leaf then gives whole epochs and, of one more, a prefix in a seeded order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.skew import attach
from donorlens.llm.store import written

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf whose running totals one task forms.
BUCKET_ROWS = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """The tables have no domain: the number at the end of the source, modulo 4, stands for it."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), number.cast("int") % 4))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        if weight < 1:
            raise ValueError(f"weight of {name} must be at least 1")
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Share each parent's `budget` among its children by `weight`, none above its `capacity`; what rounding leaves is lost.

    In order of capacity for weight, a child is full if its part of what the fuller ones leave is at least its capacity.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity").cast("double") / F.col("weight"), *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = wide("capacity") * F.col("weight_rest") <= (wide("budget") - F.col("capacity_before")) * F.col("weight")
    marked = (
        children.withColumn("capacity_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("weight_rest", F.sum("weight").over(rest))
        .withColumn("full", full)
    )
    left = marked.withColumn(
        "budget_left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    ).withColumn("weight_left", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
    part = F.expr("cast(budget_left as decimal(38,0)) * weight div weight_left")
    share = F.when(F.col("full"), F.col("capacity")).otherwise(part)
    return left.withColumn("share", share.cast("long")).drop("capacity_before", "weight_rest", "full", "budget_left", "weight_left")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """`leaves`: domain, lang, source, supply. Adds the budget of each leaf."""
    leaves = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    parents = leaves.agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
    parents = parents.select(F.least(budget, F.col("capacity")).cast("long").alias("budget"))
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        # The root is one row; below it, parents and children meet on the parent's key.
        nodes = nodes.join(parents, keys[:-1]) if keys[:-1] else nodes.crossJoin(F.broadcast(parents))
        parents = _fill(nodes, keys[:-1]).select(*keys, F.col("share").alias("budget"))
    return leaves.join(parents, list(LEVELS)).drop("capacity")


def _leaf_key() -> Column:
    return F.concat_ws("\x1f", *LEVELS)


def _order_key(seed: str) -> Column:
    """The place of a document in the partial epoch of its leaf, which is number `epochs`."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _placed(df: DataFrame, lang_col: str, source_col: str, domain) -> list[Column]:
    none = F.lit("none")
    return [
        domain(df[source_col]).alias("domain"),
        F.coalesce(df[lang_col], none).alias("lang"),
        F.coalesce(df[source_col], none).alias("source"),
    ]


def plan_mixture(docs: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: str) -> DataFrame:
    """One row per leaf: leaf, n (its rows), epochs that it gives whole, and the last key of its partial epoch (or null).

    `docs`: doc_id, domain, lang, source, n_tokens.
    """
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n"))
    leaves = written(leaves, "mix-leaves")
    budget = F.expr(f"supply * {round(share * 1000)} div 1000")
    budgets = leaf_budgets(leaves.drop("n"), budget, weights, max_epochs)
    epochs = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0)
    rest = F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0)
    plan = budgets.join(leaves.drop("supply"), list(LEVELS))
    plan = written(plan.select(_leaf_key().alias("leaf"), "n", epochs.alias("epochs"), rest.alias("rest")), "mix-plan")
    total, most = plan.agg(F.sum("n"), F.max("n")).first()
    digits = max(1, math.ceil(math.log(max(most or 0, 1) / BUCKET_ROWS, 16)))
    units = docs.groupBy(_leaf_key().alias("leaf"), "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    rows = attach(units, plan, "leaf", "n", total or 0).where("rest > 0").withColumn("key", _order_key(seed))
    last = _last_keys(rows.withColumn("bucket", F.substring("key", 1, digits)))
    return written(plan.join(last, "leaf", "left").select("leaf", "n", "epochs", "last_key"), "mix-last")


def _last_keys(rows: DataFrame) -> DataFrame:
    """The last key of each leaf before which there are fewer tokens than its rest.

    Running totals in two steps: over buckets of the order's first digits, then inside each bucket, so that no leaf has to
    fit in one task.
    """
    group = ["leaf", "bucket"]
    inside = Window.partitionBy(*group).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group).agg(F.sum("n_tokens").alias("tokens"))
    across = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, F.coalesce(F.sum("tokens").over(across), F.lit(0)).alias("offset"))
    before = F.col("offset") + F.coalesce(F.col("inside"), F.lit(0))
    placed = rows.withColumn("inside", F.sum("n_tokens").over(inside)).join(offsets, group)
    return placed.where(before < F.col("rest")).groupBy("leaf").agg(F.max("key").alias("last_key"))


def _repeated(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Each row of a leaf once for each epoch that takes it. `rows` have doc_id and leaf; adds `epoch`."""
    total = plan.agg(F.sum("n")).first()[0] or 0
    planned = attach(rows, plan, "leaf", "n", total)
    taken = F.col("epochs") + F.when(_order_key(seed) <= F.col("last_key"), 1).otherwise(0)
    planned = planned.withColumn("taken", taken).where("taken > 0")
    return planned.withColumn("epoch", F.explode(F.expr("sequence(0L, taken - 1)"))).drop("n", "epochs", "last_key", "taken", "leaf")


def mix(
    df: DataFrame,
    weights: dict[str, dict[str, int]],
    share: float = 0.6,
    max_epochs: int = 4,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain=source_domain,
) -> DataFrame:
    """One row per selected document and epoch: doc_id, domain, lang, source, n_tokens, epoch.

    The budget is `share` of all tokens (words), in thousandths. A document of the last, partial epoch is selected if the
    tokens before it, in the order of md5(seed:epoch:doc_id), are fewer than the rest of its leaf's budget; the prefix so
    covers the rest, by less than one document too many. Null languages and sources form leaves named "none"; null and
    empty texts have no tokens. Null ids order as empty. Rows that repeat an id in a leaf are selected together. An empty
    table gives an empty result. Columns other than the four named ones are not read.
    """
    docs = written(
        df.select(
            df[id_col].alias("doc_id"),
            *_placed(df, lang_col, source_col, domain),
            count_words(df[text_col]).alias("n_tokens"),
        ),
        "mix-docs",
    )
    plan = plan_mixture(docs, weights, share, max_epochs, seed)
    out = _repeated(docs.withColumn("leaf", _leaf_key()), plan, seed)
    return out.select("doc_id", *LEVELS, "n_tokens", "epoch")


def mixed_rows(
    df: DataFrame,
    weights: dict[str, dict[str, int]],
    share: float = 0.6,
    max_epochs: int = 4,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain=source_domain,
) -> DataFrame:
    """The rows of `df`, with all their columns, as often as epochs select them: `mix` applied without a join by id."""
    placed = _placed(df, lang_col, source_col, domain)
    docs = df.select(df[id_col].alias("doc_id"), *placed, count_words(df[text_col]).alias("n_tokens"))
    plan = plan_mixture(written(docs, "mix-docs"), weights, share, max_epochs, seed)
    whole = F.struct(*(df[c] for c in df.columns)).alias("whole")
    rows = df.select(df[id_col].alias("doc_id"), F.concat_ws("\x1f", *placed).alias("leaf"), whole)
    return _repeated(rows, plan, seed).select("whole.*")
