"""Chat formatting: a fingerprint of a record's nested field paths selects the declarative mapping to canonical turns.

A record is JSON text, a variant, or typed columns. The paths of its fields that are not null (`messages[].role`), as far as
any layout knows them, are hashed; each layout states the paths it has, so that one look into a map finds the mapping. A
template then joins the turns of a conversation and marks which bytes a loss is taken of.

Everything is a DataFrame expression. The turns of a conversation meet in one shuffle, each turn already formatted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings.
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


@dataclass(frozen=True)
class Layout:
    """How one kind of record holds its turns.

    `fields`: (role, paths) in order, a turn of each from those of its paths that are there, joined by an empty line. Behind
    them come the elements of the list `turns`, each with a `role` and a `text` path of its own; `turns=""` is the record
    itself. `renamed` are roles under other names. Paths in `optional` may be missing; those that nothing reads may be there.
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    renamed: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> frozenset[str]:
        own = {p for _, paths in self.fields for p in paths} | set(self.optional)
        if self.turns is not None:
            prefix = f"{self.turns}[]." if self.turns else ""
            own |= {prefix + self.role, prefix + self.text}
        return frozenset(own)

    def fingerprints(self) -> list[str]:
        """Of the paths with every choice of the optional ones."""
        required = self.paths - set(self.optional)
        return [
            fingerprint(required | set(some)) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)
        ]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


SYSTEM = ("system", ("system",))
RECORD_LAYOUTS = (
    Layout("messages", (SYSTEM,), "messages", optional=("system", "prompt")),
    Layout("parts", (SYSTEM,), "messages", text="content[].text", optional=("system", "messages[].content[].type")),
    Layout(
        "conversations",
        (SYSTEM,),
        "conversations",
        "from",
        "value",
        {"human": "user", "gpt": "assistant"},
        ("system",),
    ),
    Layout("completion", (SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("response", (SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout(
        "instruction",
        (SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("system", "input"),
    ),
    Layout("question", (("user", ("question",)), ("assistant", ("answer",)))),
)
#: Tables with a row for each turn. A row stays a turn if its role or its text is null.
TURN_ROWS = (Layout("turn", turns="", text="text", optional=("role", "text")),)


def _let(value: Column, of) -> Column:
    """`of(value)` with `value` computed once."""
    return F.transform(F.array(value), of)[0]


# Field paths


def variant_paths(record: Column) -> Column:
    """Paths of the fields of a variant that are not null, sorted; `[]` stands for the elements of a list.

    They are read off the variant's schema, a text such as `OBJECT<a: ARRAY<OBJECT<b: STRING>>>`: a stack holds the path
    whose type comes next, and each type that ends takes its path off.
    """
    pattern = r"`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<|>|\w+(?:\([0-9, ]*\))?"
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(pattern), F.lit(0))
    texts = "array<string>"
    start = F.struct(F.array(F.lit("")).alias("stack"), F.array().cast(texts).alias("paths"))

    def step(state: Column, token: Column) -> Column:
        stack, paths = state["stack"], state["paths"]
        top = F.element_at(stack, -1)
        popped = F.slice(stack, F.lit(1), F.size(stack) - 1)
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", ""), "``", "`")
        inner = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        scalar = ~token.isin("OBJECT<", "ARRAY<", ">", "VOID")
        return F.struct(
            F.when(token.endswith(": "), F.array_append(stack, inner))
            .when(token == "ARRAY<", F.array_append(stack, F.concat(top, F.lit("[]"))))
            .when(token == "OBJECT<", stack)
            .otherwise(popped)
            .alias("stack"),
            F.when(scalar & ~token.endswith(": "), F.array_append(paths, top)).otherwise(paths).alias("paths"),
        )

    found = F.aggregate(tokens, start, step, lambda state: state["paths"])
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast(texts))))


def typed_paths(record: Column, kind: T.DataType, known: Sequence[str]) -> Column:
    """Those of the `known` paths that a struct column has and that are not null in the row, sorted."""
    there = [F.when(_is_there(record, kind, path.replace("[]", ".[]").split(".")), F.lit(path)) for path in sorted(known)]
    return F.array_compact(F.array(*there)) if there else F.array().cast("array<string>")


def _is_there(value: Column, kind: T.DataType, path: list[str]) -> Column:
    if not path:
        return value.isNotNull()
    if path[0] == "[]":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return F.coalesce(F.exists(value, lambda x: _is_there(x, kind.elementType, path[1:])), F.lit(False))
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        return F.lit(False)
    return _is_there(value[path[0]], kind[path[0]].dataType, path[1:])


# From records to turns


def _text(value: Column, kind: T.DataType, path: str) -> Column:
    """The text at a path, null if it isn't there; texts of a list's elements are joined."""
    head, listed, rest = path.partition("[].")
    if isinstance(kind, T.VariantType):
        if listed:
            return F.array_join(F.transform(_items(value, kind, head), lambda x: _text(x, kind, rest)), "")
        return F.try_variant_get(value, f"$.{head}", "string")
    for name in head.split("."):
        value, kind = value[name], kind[name].dataType
    if listed:
        return F.array_join(F.transform(value, lambda x: _text(x, kind.elementType, rest)), "")
    return value.cast("string")


def _items(value: Column, kind: T.DataType, path: str) -> Column:
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.try_variant_get(value, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    return value[path]


def _has(kind: T.DataType, path: str) -> bool:
    """Whether a value of this type can have the path at all."""
    if isinstance(kind, T.VariantType):
        return True
    for step in path.replace("[]", ".[]").split("."):
        if step == "[]" and isinstance(kind, T.ArrayType):
            kind = kind.elementType
        elif isinstance(kind, T.StructType) and step in kind.names:
            kind = kind[step].dataType
        else:
            return False
    return True


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, record: Column, kind: T.DataType) -> Column:
    """The record's turns as this layout has them: an array of (role, text)."""
    turns = []
    for role, paths in layout.fields:
        texts = [_text(record, kind, p) for p in paths if _has(kind, p)]
        there = [t.isNotNull() for t in texts]
        if texts:
            any_there = there[0] if len(there) == 1 else there[0] | there[1]
            joined = F.concat_ws("\n\n", *(F.nullif(t, F.lit("")) for t in texts))
            turns.append(F.when(any_there, F.array(_turn(F.lit(role), joined))).otherwise(F.array()))

    def of_element(element: Column, kind: T.DataType) -> Column:
        role = _text(element, kind, layout.role)
        if layout.renamed:
            names = F.create_map(*(F.lit(x) for pair in layout.renamed.items() for x in pair))
            role = F.coalesce(F.try_element_at(names, role), role)
        return _turn(role, _text(element, kind, layout.text))

    if layout.turns == "":
        turns.append(F.array(of_element(record, kind)))
    elif layout.turns is not None:
        inner = kind if isinstance(kind, T.VariantType) else kind[layout.turns].dataType.elementType
        turns.append(F.transform(_items(record, kind, layout.turns), lambda x: of_element(x, inner)))
    return F.concat(*turns).cast("array<struct<role:string,text:string>>")


def with_layouts(records: DataFrame, record: Column, kind: T.DataType, layouts: Sequence[Layout]) -> DataFrame:
    """`records` with `_paths` (the known ones), `_print` (their hash), `_layout` (its name or null) and `_turns`.

    `record` is a column of `records` of type `kind`: JSON text, a variant or a struct. Texts that are no JSON have no
    paths; without a layout of no paths they have no layout.
    """
    known = sorted(set().union(*(layout.paths for layout in layouts)))
    chosen: dict[str, str] = {}
    for layout in layouts:
        for code in layout.fingerprints():
            if chosen.setdefault(code, layout.name) != layout.name:
                raise ValueError(f"layouts {chosen[code]} and {layout.name} have the same paths")
    if isinstance(kind, T.StringType):
        record, kind = F.try_parse_json(record), T.VariantType()
    records = records.withColumn("_record", record)
    record = F.col("_record")
    if isinstance(kind, T.VariantType):
        paths = F.array_intersect(variant_paths(record), F.array(*map(F.lit, known)))
    else:
        paths = typed_paths(record, kind, known)
    names = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair))
    records = records.withColumn("_paths", paths).withColumn("_print", F.md5(F.array_join("_paths", "\n")))
    records = records.withColumn("_layout", F.try_element_at(names, F.col("_print")))
    turns = F.lit(None)
    for layout in layouts:
        if all(_has(kind, p) for p in layout.paths - set(layout.optional)):
            turns = F.when(F.col("_layout") == layout.name, _turns(layout, record, kind)).otherwise(turns)
    return records.withColumn("_turns", turns)


def canonical_turns(
    records: DataFrame,
    id_col: str = "conv_id",
    record_col: str | None = "record",
    order_col: str | None = None,
    layouts: Sequence[Layout] = RECORD_LAYOUTS,
) -> DataFrame:
    """One row for each turn: conv_id, turn, place, role, text.

    The record is the column `record_col` (JSON text, variant or struct), or without it the row itself, of which the columns
    that a layout knows are read. `turn` is the value of `order_col`, else 0; `place` numbers the turns of a record from 0.
    Null roles and texts are empty. Records that no layout fits give no turns; `unmapped` shows them. Repeated records, ids
    and nulls in any column stay as they are; other columns are not read; an empty table gives an empty result.
    """
    found = _mapped(records, id_col, record_col, order_col, layouts)
    turns = found.select("_id", "_order", F.posexplode("_turns").alias("place", "_turn"))
    return turns.select(
        F.col("_id").alias("conv_id"), F.col("_order").alias("turn"), "place", F.col("_turn.role"), F.col("_turn.text")
    )


def unmapped(
    records: DataFrame,
    id_col: str = "conv_id",
    record_col: str | None = "record",
    layouts: Sequence[Layout] = RECORD_LAYOUTS,
) -> DataFrame:
    """The records that no layout fits, by fingerprint: fingerprint, paths (those that a layout knows), records, an id."""
    found = _mapped(records, id_col, record_col, None, layouts).where(F.col("_layout").isNull())
    return found.groupBy(F.col("_print").alias("fingerprint"), F.col("_paths").alias("paths")).agg(
        F.count(F.lit(1)).alias("records"), F.min("_id").alias("least_id")
    )


def _mapped(records, id_col, record_col, order_col, layouts) -> DataFrame:
    order = records[order_col] if order_col else F.lit(0)
    if record_col:
        record, kind = records[record_col], records.schema[record_col].dataType
    else:
        known = {p.split(".")[0].removesuffix("[]") for layout in layouts for p in layout.paths}
        own = [f for f in records.schema.fields if f.name in known]
        record, kind = F.struct(*(records[f.name].alias(f.name) for f in own)), T.StructType(own)
    rows = records.select(records[id_col].alias("_id"), order.cast("long").alias("_order"), record.alias("_given"))
    return with_layouts(rows, F.col("_given"), kind, layouts)


# The template


def escaped(text: Column) -> Column:
    """No control string is left: a backslash more stands between `<` and `|`, however many were there."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def format_turns(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row for each conversation of `canonical_turns`: conv_id, formatted, loss.

    Turns come by turn, then place, role and text (nulls first), so ties have an order. `loss` lists (start, end) in bytes of
    UTF-8, the end exclusive, of the escaped texts of the roles that a loss is taken of; an empty text has an empty span. Turns
    whose conv_id is null are one conversation. A conversation is one value and so has to fit into memory (2 GB).
    """
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    body = F.col("_body")
    ordered = Window.partitionBy("conv_id").orderBy("turn", "place", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    marked = turns.withColumn("_body", escaped(F.col("text"))).withColumn("_head", head)
    size = F.octet_length("_head") + F.octet_length("_body") + len(f"{END}\n")
    marked = marked.withColumn("_before", F.coalesce(F.sum(size).over(ordered), F.lit(0)))
    start = F.col("_before") + F.octet_length("_head")
    parts = marked.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_before").alias("at"),
                    F.concat("_head", body, F.lit(f"{END}\n")).alias("segment"),
                    F.when(F.col("role").isin(*loss_roles), F.struct(start.alias("start"), (start + F.octet_length(body)).alias("end"))).alias("loss"),
                )
            )
        ).alias("parts")
    )
    return parts.select(
        "conv_id",
        F.array_join(F.col("parts.segment"), "").alias("formatted"),
        F.array_compact(F.col("parts.loss")).alias("loss"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: an array of (role, text)."""

    def turn(segment: Column) -> Column:
        return _let(F.substring_index(segment, "\n", 1), lambda head: of_head(segment, head))

    def of_head(segment: Column, head: Column) -> Column:
        role = unescaped(F.replace(F.substring(head, F.lit(len(START) + 1), F.char_length(head)), F.lit(LINE), F.lit("\n")))
        text = F.substring(segment, F.char_length(head) + 2, F.char_length(segment))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""

    def cut(data: Column) -> Column:
        texts = F.transform(loss, lambda s: F.substring(data, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).cast("string"))
        return F.array_join(F.transform(texts, unescaped), "")

    return _let(formatted.cast("binary"), cut)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from `format_turns`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = formatted.select(
        "conv_id",
        parsed_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss")).alias("under_loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
