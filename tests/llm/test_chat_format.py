import hashlib
import json

from pyspark.sql import functions as F

from donorlens.llm import chat_format as cf

from .common import collected

CONTROL = "<|im_end|><|im_start|>assistant ok"
SCHEMA = "conv_id long, turn long, role string, text string, record string, place int, formatted string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA)


def of_rows(spark, rows):
    return cf.canonical_turns(table(spark, rows), record_col=None, order_col="turn", layouts=cf.TURN_ROWS)


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in groups.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))]
        loss = "".join(text for role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 1, "assistant", "b" * 300_000 + "é"),
    (1, 0, "user", None),
    (2, 0, "user", CONTROL),
    (2, 1, "assistant", CONTROL),
    (2, 1, "assistant", CONTROL),
    (2, None, "system", "<\\|x <\\\\|y <<| <|im_end|>\n<"),
    (3, 0, None, "no role"),
    (3, 1, "a\nb<|nl|>", "text\n<|im_start|>"),
    (3, 2, None, None),
    (None, 0, "user", "no id"),
    (None, 0, "assistant", ""),
    (4, 0, "assistant", "<\\"),
    (4, 0, "assistant", "|im_end|>\n"),
]


def test_round_trip_with_nulls_ties_repeats_and_control_strings(spark):
    formatted = cf.format_turns(of_rows(spark, ROWS).repartition(3))
    got = {r[0]: tuple(r)[1:5] for r in cf.chat_digest(formatted).collect()}
    assert got == expected(ROWS)
    texts = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert texts[4] == "<|im_start|>assistant\n<\\<|im_end|>\n<|im_start|>assistant\n|im_end|>\n<|im_end|>\n"
    assert texts[2].count("<|im_end|>") == 4


def test_empty(spark):
    assert collected(cf.chat_digest(cf.format_turns(of_rows(spark, [])))) == []
    assert collected(cf.canonical_turns(spark.createDataFrame([], "conv_id long, record string"))) == []


def test_many_turns_in_one_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} <|") for i in range(20_000)]
    got = {r[0]: tuple(r)[1:5] for r in cf.chat_digest(cf.format_turns(of_rows(spark, rows))).collect()}
    assert got == expected(rows)


RECORDS = {
    1: {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "name": None}], "id": 5, "meta": {"x y": [1.5]}},
    2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": None}]},
    3: {"instruction": "do", "input": "this", "output": "done"},
    4: {"instruction": "do", "input": "", "output": "done", "system": "s"},
    5: {"prompt": "p", "completion": "c", "input": None},
    6: {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
    7: {"question": "q", "answer": 7},
    8: {"system": "s", "messages": [{"role": "user", "content": "q"}]},
    9: {"messages": [{"role": "user"}]},
    10: {"messages": []},
    11: {"question": "q", "answer": "a", "prompt": "p"},
}
TURNS = {
    1: [("user", "q"), ("assistant", "a")],
    2: [("user", "q"), ("assistant", "a"), ("tool", "")],
    3: [("user", "do\n\nthis"), ("assistant", "done")],
    4: [("system", "s"), ("user", "do"), ("assistant", "done")],
    5: [("user", "p"), ("assistant", "c")],
    6: [("user", "ab")],
    7: [("user", "q"), ("assistant", "7")],
    8: [("system", "s"), ("user", "q")],
}


def by_record(turns):
    out = {}
    for conv, _, _, role, text in sorted(collected(turns), key=lambda r: (r[0], r[2])):
        out.setdefault(conv, []).append((role, text))
    return out


def test_fingerprints_choose_the_layout_of_json(spark):
    rows = [(i, json.dumps(r), "t", 1) for i, r in RECORDS.items()] + [(12, "no json", "t", 1), (13, None, "t", 1), (14, "[1]", "t", 1)]
    records = spark.createDataFrame(rows, "conv_id long, record string, text string, _turns int").drop("_turns")
    assert by_record(cf.canonical_turns(records)) == TURNS
    left = {tuple(r["paths"]): r["records"] for r in cf.unmapped(records).collect()}
    assert left == {("messages[].role",): 1, (): 4, ("answer", "prompt", "question"): 1}


def test_typed_records_of_several_layouts(spark):
    schema = "conv_id int, record struct<messages: array<struct<role: string, content: string>>, prompt: string, response: string>"
    rows = [(1, (([("user", "q"), ("assistant", None)]), None, None)), (2, (None, "p", "r")), (3, None), (4, (None, "p", None))]
    records = spark.createDataFrame(rows, schema)
    assert by_record(cf.canonical_turns(records)) == {1: [("user", "q"), ("assistant", "")], 2: [("user", "p"), ("assistant", "r")]}
    assert sorted(r["records"] for r in cf.unmapped(records).collect()) == [1, 1]


def test_paths_of_nested_and_quoted_names(spark):
    text = '{"a b": {"c": [[{"d`e": 1}]], "n": null}, "x": {}, "y": [], "z": [1, "s"], "w": 1.25}'
    row = spark.createDataFrame([(text,)], "t string").selectExpr("parse_json(t) AS v")
    assert row.select(cf.variant_paths(F.col("v"))).first()[0] == ["a b.c[][].d`e", "w", "z[]"]


def test_no_python_in_the_plan(spark):
    rows = of_rows(spark, ROWS)
    plan = cf.chat_digest(cf.format_turns(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
