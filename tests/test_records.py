import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import normalize as norm
from ledgerloom.operators import programs, prompts, targets
from ledgerloom.functions import text as txt

RAW = "id string, pre_text array<string>, `table` array<array<string>>, post_text array<string>, qa struct<question: string, program: string, exe_ans: string, gold_inds: array<string>>, filename string"
ROWS = "id string, context string, question string, gold string, answer_type string, program string, subtype string, evidence array<string>, metadata struct<raw_table_rows: int>, prompt string"


def test_normalize(spark):
    raw = [
        ("a", [" Before. ", ""], [["", "2013"], ["x", " 5 "], [" ", None]], None, (" What grew? ", "divide(1, 2)", "50%", ["table_1"]), "f.pdf"),
        ("b", None, None, None, ("q", None, "5", None), None),
        (" ", ["t"], None, None, ("q", None, "5", None), None),
        ("d", ["t"], None, None, None, None),
        ("e", ["t"], None, None, ("q", "", " ", None), None),
    ]
    n = {r.id: r for r in norm.normalize_records(spark.createDataFrame(raw, RAW), "train").collect()}
    a = n["a"]
    assert a.context == "Pre-text:\nBefore.\n\nTable:\n | 2013\nx | 5\n |"
    assert a.prompt == f"Context:\n{a.context}\n\nQuestion: What grew?"
    assert (a.subtype, a.answer_type, a.source_split, list(a.evidence), a.error) == ("ratio", "percent", "train", ["table_1"], None)
    assert (a.metadata.filename, a.metadata.raw_table_rows, a.metadata.has_program) == ("f.pdf", 3, True)
    assert [n[k].error for k in ("b", "", "d", "e")] == ["missing_context", "missing_id", "missing_question", "missing_gold"]
    with pytest.raises(Exception, match="missing_"):
        norm.require_complete(norm.normalize_records(spark.createDataFrame(raw, RAW))).collect()
    flat = spark.createDataFrame([("u1", "page text", "why?", "12")], "uid string, text string, question string, answer string")
    r = norm.normalize_records(flat).first()
    assert (r.id, r.context, r.gold, r.subtype, r.answer_type) == ("u1", "page text", "12", "lookup", "number")
    assert norm.normalize_records(spark.createDataFrame([], RAW)).count() == 0


@pytest.mark.parametrize(
    "question,program,gold,want",
    [("what share?", "divide(1, 2)", "0.5", "ratio"), ("what total?", "add(1, 2), subtract(#0, 3)", "0", "multi_step"), ("what total?", "add(1, 2)", "3", "arithmetic"),
     ("what is it?", "", "3", "lookup"), ("what margin?", None, "3", "ratio"), ("x", "add(1, 2)", "Not enough information", "unanswerable")],
)
def test_subtype(spark, question, program, gold, want):
    df = spark.createDataFrame([(question, program, gold)], "q string, p string, g string")
    assert df.select(norm.subtype(F.col("q"), F.col("p"), F.col("g")).alias("s")).first().s == want


def row(i, program, gold, question="what was the change?", kind="number", context="Table:\n1 2", evidence=None, table_rows=0):
    return (i, context, question, gold, kind, program, "ratio", evidence, (table_rows,), f"prompt {i}")


def make(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def test_validate_and_build(spark):
    df = make(
        spark,
        row("ok", "subtract(85.00, const_100), divide(#0, const_100)", "-15%", "what was the percentage increase?", "percent"),
        row("wrong", "add(1, 2)", "4"),
        row("marker", "Final answer: 5", "5"),
        row("table", "table_max(row name, none)", "5"),
        row("none", None, "5"),
        row("lines", "add(1, 2)\nadd(3, 4)", "7"),
        row("op", "median(1, 2)", "1"),
    )
    errors = {r.id: [e.split(":")[0] for e in r.check.errors] for r in targets.validate_programs(df).collect()}
    assert errors["ok"] == [] and errors["wrong"] == ["gold_mismatch"] and errors["none"] == ["missing_program"]
    assert "contains_non_program_text" in errors["marker"] and errors["table"] == ["execution_error"]
    assert errors["lines"][0] == "not_one_line" and "unsupported_operation" in errors["op"]
    built = targets.source_targets(df).collect()
    assert [r.id for r in built] == ["ok"]
    assert json.loads(built[0].assistant_source_program) == {
        "source_numbers": ["85.00"],
        "constants": ["const_100"],
        "operation_class": "percent_change",
        "program": "subtract(85.00, const_100), divide(#0, const_100)",
    }
    assert {"percent_change_template", "unit_scale", "multi_step_program"} <= set(built[0].source_program_tags)
    checked = targets.validate_source_targets(targets.source_targets(df)).first()
    assert list(checked.source_errors) == []
    broken = spark.createDataFrame([("x", "{bad", "1"), ("y", '{"program":"add(1, 2)","operation_class":"a","source_numbers":["9"],"constants":[]}', "3")], "id string, assistant_source_program string, gold string")
    got = {r.id: list(r.source_errors) for r in targets.validate_source_targets(broken).collect()}
    assert got["x"][0] == "invalid_json" and got["y"] == ["source_numbers_do_not_match_program"]
    report = targets.program_report(df, "program").first()
    assert (report.n, report.valid, report.invalid) == (7, 1, 6)
    assert json.loads(report.by_subtype) == {"ratio": 7}
    with pytest.raises(targets.ValidationGate):
        targets.gate(targets.program_report(df, "program"))
    empty = targets.program_report(df.limit(0), "program").first()
    assert (empty.n, empty.executable_rate) == (0, 0.0)


@pytest.mark.parametrize(
    "program,question,kind,want",
    [("multiply(25%, 5283.3)", "what was the value in millions?", "currency", "unit_scale"), ("divide(558360, 531822)", "how does it relate?", "number", "ratio"),
     ("greater(1, 2)", "more?", "text", "comparison"), ("subtract(3, 2)", "what gap?", "number", "difference"), ("add(3, 2)", "what is it?", "number", "sum_or_lookup"),
     ("multiply(3, 2)", "what product?", "number", "product_or_share"), ("table_sum(1, 2)", "what?", "number", "table_aggregation")],
)
def test_operation_class(spark, program, question, kind, want):
    df = spark.createDataFrame([(program, question, kind)], "p string, q string, k string")
    ops = programs.program_ops(F.col("p"))
    tags = programs.target_tags(F.col("p"), F.col("q"), F.lit(""), F.col("k"), F.lit(0), ops, F.size(ops))
    assert df.select(programs.operation_class(ops, tags, F.col("q"), F.col("k")).alias("c")).first().c == want


def test_calculation_and_chat(spark):
    df = make(
        spark,
        row("a", "subtract(150, -233)", "383", evidence=["{'table_1': 'x ; 1'}", "text  two"]),
        row("b", "add(1, 2)", "0"),
        row("c", "subtract(1, 1)", "0"),
        row("d", "add(1, 2)", None),
    )
    t = targets.reasoning_targets(df).collect()
    assert [r.id for r in t] == ["a"]
    assert t[0].assistant_target == "Evidence: x ; 1; text two\nCalculation: 150 - (-233) = 383\nFinal answer: 383"
    chats = targets.reasoning_chat(df).first().messages
    assert [m.role for m in chats] == ["system", "user", "assistant"] and chats[2].reasoning_content.startswith("Evidence:")
    final = {r.id: r.messages[2].content for r in targets.answer_chat(df).collect()}
    assert final["a"] == "Final answer: 383" and final["d"] == "Final answer: "
    assert targets.chat_report(targets.program_chat(df), 3).first().count_ok
    assert targets.chat_report(targets.reasoning_chat(df)).first().invalid == 1
    assert targets.source_chat(df, True).first().messages[1].content.endswith("/no_think")


def test_prompts(spark):
    df = spark.createDataFrame([(" ctx ", "q?", "add(1, 2)")], "c string, q string, p string")
    m = df.select(prompts.answer_prompt(F.col("c"), F.col("q"), F.col("p"), True).alias("m")).first().m
    assert m[1].content.startswith("Context:\nctx\n\nQuestion: q?\n\n") and m[1].content.endswith("hint: add(1, 2)\n\n/no_think")
    assert df.select(prompts.source_prompt(F.col("c"), F.col("q")).alias("m")).first().m[0].role == "system"
    assert df.select(txt.markdown_cell(F.lit("a|b\nc")).alias("x")).first().x == "a\\|b c"
