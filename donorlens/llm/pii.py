"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Everything is a DataFrame expression. A pattern's matches come from `regexp_extract_all` and the text between them from
`split` with the same pattern, so that running sums of their lengths give each match's position in code points.

The patterns are the plain ones of the contract with possessive quantifiers and a look-behind that lets a match begin
only where a run of its characters begins (or where the match before ended, `\\G`). That changes no match, but keeps the
search linear in texts that are one long run. An IBAN may be followed by capitals and digits that look like more of it, so its
pattern proposes beginnings only, and mod-97 tests what is behind them up to the country's length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span, as far as the next span of its kind, in which context words count.
CONTEXT = 40
#: Matches whose lengths are summed at a time.
CHUNK = 128
#: Scores: what a kind starts from, and what a context word adds.
WITH_CONTEXT = 0.35
#: Spans of the added kinds are kept from this score on; base spans are kept at any score.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """How one kind is found. `only_if`: a literal without which no match exists, or None."""

    name: str
    pattern: str
    score: float
    context: str
    base: bool
    only_if: str | None = None


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        "e-?mail|mail|contact|write",
        True,
        "@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|login", True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|master|credit|payment|iban", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", True, "+"),
    # The kinds that the method adds.
    # The beginning of an IBAN; the group is the text behind it, with room for 34 spaced characters and for context.
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11}[\s\S]{0,130}))",
        0.7,
        "iban|bank|account",
        False,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security", False, "-"),
)

#: Characters of an IBAN by country; those of other codes have 15 to 34.
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the mod-97 check: rearranged, with letters as two digits, the number leaves 1."""
    plain = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return F.when(code >= 65, rest * 100 + value).otherwise(rest * 10 + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _small_parts(ip: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(ip, r"\."), small)


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return _small_parts(match)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with `value` computed once, however often `of` uses it inside other lambdas."""
    return F.transform(F.array(value), of)[0]


def _placed(between: Column, matches: Column) -> Column:
    """Array of (match, start, end, before, after): the matches with their places and the text around them.

    Running sums of lengths, first over chunks of matches and then inside each: an array that grows by one element at a
    time is copied each time, so one pass would take time by the square of the matches.
    """
    n = F.size(matches)
    pairs = F.arrays_zip(
        F.slice(between, F.lit(1), n).alias("before"), matches.alias("match"), F.slice(between, F.lit(2), n).alias("after")
    )
    return _bound(pairs, _placed_pairs)


def _size(pair: Column) -> Column:
    return F.char_length(pair["before"]) + F.char_length(pair["match"])


def _placed_pairs(pairs: Column) -> Column:
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)),
    )
    return _bound(chunks, _placed_chunks)


def _placed_chunks(chunks: Column) -> Column:
    sums = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda total, p: total + _size(p)))
    offsets = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda state, x: F.struct((state["at"] + x).alias("at"), F.array_append(state["all"], state["at"]).alias("all")),
        lambda state: state["all"],
    )

    def step(state: Column, p: Column) -> Column:
        start, end = state["at"] + F.char_length(p["before"]), state["at"] + _size(p)
        found = F.struct(
            p["match"].alias("match"),
            start.alias("start"),
            end.alias("end"),
            F.right(p["before"], F.lit(CONTEXT)).alias("before"),
            F.left(p["after"], F.lit(CONTEXT)).alias("after"),
        )
        return F.struct(end.alias("at"), F.array_append(state["found"], found).alias("found"))

    none = F.array().cast("array<struct<match:string,start:int,end:int,before:string,after:string>>")
    of_chunk = lambda c: F.aggregate(
        c["pairs"], F.struct(c["at"].alias("at"), none.alias("found")), step, lambda state: state["found"]
    )
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("pairs"), offsets.alias("at")), of_chunk))


def _iban_at_start(text: Column) -> Column:
    """The IBAN that a text begins with, or null: of its country's length or, for other codes, the longest that passes."""
    known = F.create_map(*(F.lit(x) for n, codes in IBAN_COUNTRIES.items() for code in codes.split() for x in (code, n)))
    length = F.try_element_at(known, F.left(text, F.lit(2)))
    lengths = F.when(length.isNull(), F.sequence(F.lit(34), F.lit(15), F.lit(-1))).otherwise(F.array(length))

    def prefix(n: Column) -> Column:
        pattern = F.concat(F.lit(r"^((?:\x20?[A-Z0-9]){"), n.cast("string"), F.lit("})(?![A-Za-z0-9])"))
        return F.call_function("regexp_extract", text, pattern, F.lit(1))

    return F.get(F.filter(F.transform(lengths, prefix), lambda p: F.when(p != "", mod97(p)).otherwise(False)), F.lit(0))


def _ibans(kind: Kind, text: Column, placed: Column) -> Column:
    """Matches as `_placed` gives them, from the beginnings of IBANs; none begins inside the one before."""

    def whole(pair: Column) -> Column:
        return _bound(F.concat(pair["head"]["match"], pair["behind"]), lambda t: with_text(pair["head"], t))

    def with_text(head: Column, t: Column) -> Column:
        return _bound(_iban_at_start(t), lambda iban: with_iban(head, t, iban))

    def with_iban(head: Column, t: Column, iban: Column) -> Column:
        size = F.char_length(iban)
        after = F.split(F.substring(t, size + 1, F.char_length(t)), kind.pattern, 2)[0]
        return F.struct(
            iban.alias("match"),
            head["start"].alias("start"),
            (head["start"] + size).alias("end"),
            head["before"].alias("before"),
            F.left(after, F.lit(CONTEXT)).alias("after"),
        )

    behind = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))
    found = F.filter(F.transform(F.arrays_zip(placed.alias("head"), behind.alias("behind")), whole), lambda m: m["match"].isNotNull())
    apart = lambda all_: F.filter(all_, lambda m, i: (i == 0) | (F.get(all_, i - 1)["end"] <= m["start"]))
    return _bound(found, apart)


def _spans(kind: Kind, text: Column) -> Column:
    """Array of (kind, start, end, score), in order of start, of the confirmed matches."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def scored(m: Column) -> Column:
        near = F.concat_ws(" ", m["before"], m["after"]).rlike(f"(?i){kind.context}")
        score = F.least(F.lit(kind.score) + F.when(near, WITH_CONTEXT).otherwise(0.0), F.lit(1.0))
        return F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"))

    placed = _placed(F.split(text, kind.pattern, -1), matches)
    if kind.name == "iban":
        placed = _ibans(kind, text, placed)
    found = F.transform(F.filter(placed, lambda m: _confirmed(kind.name, m["match"])), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    # Most texts have no match at all: the test is cheaper than taking the text apart.
    has = text.rlike(kind.pattern)
    if kind.only_if:
        has = F.contains(text, F.lit(kind.only_if)) & has
    return F.when(has, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, and per kind an array of (kind, start, end, score).

    Positions count code points, the end is exclusive. A null or empty text has no spans; ids may be null or repeat, each
    row stands for itself. Columns other than the two named ones are not read. Kinds are searched independently, so their
    spans may overlap. An empty table gives an empty result.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].alias("doc_id"), *(_spans(kind, text).alias(kind.name) for kind in KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(F.concat(*base)), 256).alias("base_sha256"),
        _joined(F.concat(*(k.name for k in KINDS))).alias("spans"),
        F.array_max(F.transform(F.concat(*(k.name for k in KINDS)), lambda s: s["score"])).alias("top_score"),
    )
