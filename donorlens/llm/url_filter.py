"""URL rules indexed by their rarest literal token.

A URL's tokens fetch the few rules that could fit it; only those run their regular expressions. Everything is a DataFrame
expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.llm.skew import attach
from donorlens.llm.store import written

#: Rule lists up to this length are broadcast; of longer ones only the rules under tokens that very many addresses have, all
#: others are joined by shuffle. The result is the same.
MAX_BROADCAST_RULES = 50_000
TOKEN = "[A-Za-z0-9]+"
RULE_SCHEMA = "rule string, verdict string, rank int, pattern string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """`||host/path`: that host and its subdomains, path prefix. Otherwise a text in the address with `*` for anything and
    `^` for a separator. Rules of `rank` 1 go before those of rank 0; among equals the longest text wins."""

    text: str
    verdict: str
    rank: int = 0


#: The rules of the contract.
HOST_RULES = (
    Rule("||com/", "allow", 1),
    Rule("||example.com/en/", "block", 1),
    Rule("||www.example.com/en/", "allow", 1),
    Rule("||net/es/", "block", 1),
    Rule("||net/fr/", "block", 1),
)
#: The patterns that judge what no host rule fits.
PATTERNS = (
    Rule("^ads-track^", "block"),
    Rule("^casino-win^", "block"),
    Rule("^adserver^", "block"),
    Rule("^doubleclick^", "block"),
    Rule("^xxx^", "block"),
    Rule("^porn^", "block"),
    Rule("^wp-login.php^", "block"),
    Rule("^cart/checkout^", "block"),
)


def _compiled(rule: Rule) -> tuple:
    """The rule's regular expression over host and path, and the literal tokens that each fitting address has as tokens."""
    if rule.text.startswith("||"):
        pattern = r"\A(?:[^/]*\.)?" + re.escape(rule.text[2:])
        literal = "." + rule.text[2:]
    else:
        special = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9%_-]|\A|\z)"}
        pattern = "".join(special.get(part, re.escape(part)) for part in re.split(r"([*^])", rule.text))
        literal = rule.text
    # A token counts only where characters that are no part of tokens bound it on both sides.
    bounded = [m for m in re.finditer(TOKEN, literal) if m.start() > 0 and m.end() < len(literal)]
    tokens = [m.group() for m in bounded if "*" not in (literal[m.start() - 1], literal[m.end()])]
    return rule.text.removeprefix("||"), rule.verdict, rule.rank, pattern, tokens


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([_compiled(rule) for rule in rules], RULE_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for null and for a text without `://`."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _index(rules: DataFrame, addresses: DataFrame, small: bool) -> DataFrame:
    """The rules by their rarest token, and how many addresses have that; `token` is "" for rules that have none.

    How often a token occurs is counted over all addresses, but only for the tokens that rules have.
    """
    sent = F.broadcast if small else lambda df: df
    of_rules = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = addresses.select(F.explode("tokens").alias("token")).join(sent(of_rules), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    per_token = rules.select("*", F.explode_outer("tokens").alias("token")).join(sent(counts), "token", "left")
    n = F.coalesce("n", F.lit(0))
    rarest = F.min_by(F.struct("token", n.alias("n")), F.struct(n, F.col("token"))).alias("of")
    index = per_token.groupBy("rule", "verdict", "rank", "pattern").agg(rarest)
    return index.select("rule", "verdict", "rank", "pattern", F.coalesce("of.token", F.lit("")).alias("token"), "of.n")


def _by_shuffle(keys: DataFrame, index: DataFrame, n_rows: int) -> DataFrame:
    """`keys` with the rules of their token. Tokens of more than a thousandth of the rows, "" among them, are broadcast with
    their rules; a row without any rule keeps its key ""."""
    rules = F.collect_list(F.struct("rule", "verdict", "rank", "pattern")).alias("rules")
    n = F.when(F.col("token") == "", F.lit(n_rows)).otherwise(F.max("n")).alias("n")
    facts = written(index.groupBy("token").agg(rules, n), "url-rules")
    found = attach(keys, facts, "token", "n", n_rows).where(F.col("rules").isNotNull() | (F.col("token") == ""))
    return found.select(*keys.columns, F.explode_outer("rules").alias("of")).select(*keys.columns, "of.*")


def filter_urls(df: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, pattern.

    `rule` is the host rule that decided, else `pattern` the pattern that did (null: none); `verdict` is its verdict, or
    `allow` where nothing fits. Null and malformed addresses have an
    empty host and path, and are allowed. Ids may be null or repeat: each row stands for itself. Columns other than the
    two named ones are not read. An empty table gives an empty result.
    """
    host, path = host_and_path(df[url_col])
    addresses = df.select(df[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    # A host has no slash and a path that isn't empty starts with one, so their joint stays known.
    tokens = F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0))
    addresses = addresses.withColumn("tokens", F.array_distinct(tokens))
    table = rules_table(df.sparkSession, rules)
    small = len(rules) <= MAX_BROADCAST_RULES
    index = _index(table, addresses, small)
    # Rules without a token are tried on every address, under the key "".
    keys = F.explode(F.concat(F.col("tokens"), F.array(F.lit(""))))
    keyed = addresses.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", keys.alias("token"))
    if small:
        tried = keyed.join(F.broadcast(index), "token", "left")
    else:
        tried = _by_shuffle(keyed, index, addresses.count())
    fits = F.regexp_like(F.concat("host", "path"), F.col("pattern"))
    best = F.max(F.when(fits, F.struct("rank", F.length("rule").alias("size"), "rule", "verdict")))
    # A row's keys lie in one partition, so the map side already leaves one row for each.
    return (
        tried.groupBy("row", "page_id", "host", "path")
        .agg(best.alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.when(F.col("best.rank") == 1, F.col("best.rule")).alias("rule"),
            F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
            F.when(F.col("best.rank") == 0, F.col("best.rule")).alias("pattern"),
        )
    )
