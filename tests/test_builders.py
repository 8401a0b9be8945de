"""Composed training sets, roll-ups and the command line, against plain Python over the same rows."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.__main__ import main
from ledgerloom.operators import builders, sampling, stats, targets

SCHEMA = (
    "id string, dataset string, source_split string, subtype string, answer_type string, context string, question string, gold string, "
    "prompt string, program string, evidence array<string>, metadata struct<filename: string, raw_table_rows: int, has_program: boolean>"
)


def record(i, subtype, program, gold, question="what was the change in revenue?", kind="number", rows=2):
    return (f"r{i}", "d", "train", subtype, kind, "Table:\na | 1", question, gold, f"Q {i}", program, ["a is 1"], ("f", rows, True))


ROWS = [record(i, "ratio", f"divide({i + 1}, 4)", str((i + 1) / 4)) for i in range(8)]
ROWS += [record(20 + i, "arithmetic", f"subtract({i + 9}, 4)", str(i + 5)) for i in range(6)]
ROWS += [record(40 + i, "lookup", f"add({i}, 0)", str(i)) for i in range(3)]
ROWS += [record(60, "ratio", "divide(1, 0)", "1"), record(61, "ratio", "divide(1, 4)", "77"), record(62, "arithmetic", None, "3")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_calculation_and_reasoning_sets(rows):
    mix = {"ratio": 3, "arithmetic": 2}
    got = builders.calculation_set(rows, 7, mix=mix).collect()
    assert len({r.id for r in got}) == 7
    kinds = [r.subtype for r in got]
    assert kinds.count("ratio") >= 3 and kinds.count("arithmetic") >= 2
    assert all(r.assistant_target.startswith("Evidence: a is 1\nCalculation: ") for r in got)
    assert {r.id for r in got}.isdisjoint({"r60", "r61", "r62"})
    again = builders.calculation_set(rows, 7, mix=mix, key="id").select("id").collect()
    assert len(again) == 7
    thought = builders.reasoning_set(rows, 5, mix=mix).first()
    assert thought.assistant_content.startswith("Final answer: ") and "Calculation" in thought.assistant_reasoning_content
    with pytest.raises(sampling.ShortfallError):
        builders.calculation_set(rows, 100, mix=mix)


def test_program_set_excludes_before_building(spark, rows):
    out = spark.createDataFrame([("r0",), ("r20",), (None,)], "id string")
    got = {r.id for r in builders.program_set(rows, 15, mix={"ratio": 9, "arithmetic": 9}, exclude=out).collect()}
    assert got == {r[0] for r in ROWS} - {"r0", "r20", "r60", "r61", "r62"}
    with pytest.raises(sampling.ShortfallError):
        builders.program_set(rows, 16, exclude=out)


def test_targeted_and_source_sets(spark):
    percent = record(1, "ratio", "subtract(150, 100), divide(#0, 100)", "50%", "what was the percent increase from 2010 to 2011?", "percent")
    sign = record(2, "arithmetic", "subtract(4, 9)", "-5", "by how much did it decrease?")
    third = record(3, "arithmetic", "subtract(4, 8)", "-4", "by how much did it decrease?")
    df = spark.createDataFrame([percent, sign, third], SCHEMA)
    mix = {"sign_direction": 1, "percent_change_template": 1}
    out = spark.createDataFrame([("r3",)], "id string")
    got = {r.id: r for r in builders.targeted_set(df, 2, mix=mix, exclude=out).collect()}
    assert set(got) == {"r1", "r2"} and all(r.targeted_selection_bucket in (*mix, "fallback") for r in got.values())
    assert {"percent_change_template", "unit_scale", "multi_step_program"} <= set(got["r1"].targeted_program_tags)
    source = {r.id: r for r in builders.source_set(df, 2, mix=mix, exclude=out).collect()}
    assert json.loads(source["r2"].assistant_source_program) == {"source_numbers": ["4", "9"], "constants": [], "operation_class": "difference", "program": "subtract(4, 9)"}
    assert all(r.source_program_selection_bucket for r in source.values())


def test_program_report_in_full(rows):
    tagged = rows.withColumn("targeted_program_tags", F.array(F.lit("x"), F.lit("y"))).withColumn("targeted_selection_bucket", F.when(F.col("subtype") == "ratio", "b"))
    r = targets.program_report(tagged, "program").first()
    assert (r.n, r.valid, r.invalid) == (20, 17, 3)
    assert json.loads(r.by_subtype) == {"arithmetic": 7, "lookup": 3, "ratio": 10}
    assert json.loads(r.targeted_program_tags) == {"x": 20, "y": 20}
    assert json.loads(r.targeted_selection_buckets) == {"b": 10}
    assert json.loads(r.operations) == {"add": 3, "divide": 10, "subtract": 6}
    assert json.loads(r.errors) == {"execution_error": 1, "gold_mismatch": 1, "missing_program": 1}
    assert [x["id"] for x in json.loads(r.invalid_examples)] == ["r60", "r61", "r62"]
    empty = targets.program_report(rows.limit(0), "program").first()
    assert (empty.n, empty.gold_match_rate, empty.operations) == (0, 0.0, "{}")


def test_source_report(spark, rows):
    built = targets.source_targets(rows)
    r = targets.source_report(built).first()
    assert (r.n, r.valid, r.json_one_line_rate, r.program_gold_match_rate) == (17, 17, 1.0, 1.0)
    assert json.loads(r.source_number_counts) == {"1": 2, "2": 15}
    bad = built.withColumn("assistant_source_program", F.lit('{"source_numbers": ["1"], "constants": [], "program": "add(1, 2)"}')).limit(2)
    r = targets.source_report(bad).first()
    assert r.invalid == 2 and json.loads(r.operation_classes) == {"unknown": 2}
    errors = json.loads(r.invalid_examples)[0]["errors"]
    assert "missing_operation_class" in errors and "source_numbers_do_not_match_program" in errors


def test_chat_report(rows):
    chats = targets.program_chat(rows)
    r = targets.chat_report(chats, 17, "id").first()
    assert (r.n, r.invalid, r.count_ok, r.errors) == (17, 0, True, "{}")
    bad = targets.answer_chat(rows)
    r = targets.chat_report(bad, 3, "id").first()
    assert (r.invalid, r.count_ok) == (20, False)
    assert json.loads(r.errors) == {"assistant_content_contains_non_program_text": 20}
    assert len(json.loads(r.invalid_examples)) == 20


def test_exact_tail_of_many_pairs():
    import pandas as pd

    exact = stats._tail(pd.Series([400]), pd.Series([900]))[0]
    from math import exp, log

    assert exp(log(2) + stats._log_tail(400, 900) - 900 * log(2)) == pytest.approx(exact, rel=1e-9)
    assert stats._tail(pd.Series([10**9]), pd.Series([2 * 10**9]))[0] == 1.0
    assert 0 < stats._tail(pd.Series([10**9 - 50_000]), pd.Series([2 * 10**9]))[0] < 0.03
    assert stats._tail(pd.Series([0]), pd.Series([4]))[0] == 0.125


def test_pluggable_statistic_and_poisson(spark):
    assert stats.parity_ci([1.0, 2.0, 9.0], 200, statistic=lambda v: max(v))[1] == 9.0
    df = spark.range(4000).selectExpr("id", "cast(id % 4 = 0 as int) v")
    r = stats.poisson_ci(df, "v", "id", 100).first()
    assert r.n == 4000 and r.low < 0.25 < r.high and r.high - r.low < 0.05
    assert stats.poisson_ci(df.limit(0), "v", "id", 10).first().n == 0


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def run(capsys, spark, *argv):
    code = main(list(argv), spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, tmp_path, capsys):
    names = [f.split(":")[0].split()[0] for f in SCHEMA.replace("struct<filename: string, raw_table_rows: int, has_program: boolean>", "s").split(", ")]
    plain = [dict(zip(names, [*r[:-1], {"filename": "f", "raw_table_rows": 2, "has_program": True}])) for r in ROWS]
    src = write(tmp_path / "rows.jsonl", plain)
    out, chat = str(tmp_path / "p.jsonl"), str(tmp_path / "c.jsonl")
    code, got = run(capsys, spark, "build-program", src, out, chat, "--total", "15")
    assert code == 0 and got["selected"] == 15 and got["validation"]["invalid"] == 0
    code, got = run(capsys, spark, "validate-program", out, "--chat", chat, "--report", str(tmp_path / "r" / "report.json"))
    assert (code, got["invalid"], got["chat"]["invalid"], got["chat"]["count_ok"]) == (0, 0, 0, True)
    assert json.loads((tmp_path / "r" / "report.json").read_text())["n"] == 15
    code, got = run(capsys, spark, "validate-program", src, "--field", "program")
    assert (code, got["invalid"]) == (1, 3)
    assert run(capsys, spark, "validate-program", src, "--field", "program", "--max-errors", "3", "--min-match-rate", "0.8")[0] == 0
    code, got = run(capsys, spark, "split", src, str(tmp_path / "split"))
    assert sum(got["rows"].values()) == len(ROWS)
    run(capsys, spark, "oracle", src, str(tmp_path / "o.jsonl"))
    _, got = run(capsys, spark, "predict", src, str(tmp_path / "g.jsonl"), "--provider", "offline_gold", "--limit", "5", "--exclude-id", "r0")
    assert got["rows"] == 5
    _, got = run(capsys, spark, "predict", src, str(tmp_path / "g.jsonl"), "--provider", "offline_gold", "--resume")
    assert got["appended"] == len(ROWS) - 5
    _, got = run(capsys, spark, "report", str(tmp_path / "rep.md"), "--run", f"a={tmp_path}/g.jsonl", "--run", f"b={tmp_path}/o.jsonl", "--baseline", "a")
    assert got["comparisons"] == 1 and "| a |" in (tmp_path / "rep.md").read_text()
    _, got = run(capsys, spark, "pack", src, str(tmp_path / "pack"), "--run", f"a={tmp_path}/g.jsonl", "--run", f"b={tmp_path}/o.jsonl", "--markdown", str(tmp_path / "pack.md"))
    assert got["rows"] == len(ROWS) and got["priority_rows"] > 0
    _, got = run(capsys, spark, "evaluate", f"{tmp_path}/g.jsonl")
    assert got["runs"][0]["summary"]["n"] == len(ROWS)
    replies = write(tmp_path / "re.jsonl", [{"id": "r0", "reply": "So divide(1, 4)."}, {"id": "r1", "reply": "none"}])
    _, got = run(capsys, spark, "plan", src, str(tmp_path / "pl.jsonl"), "--replies", replies)
    assert got["by_finish_reason"] == {"calculator_stop": 1, "planner_parse_error": 1}
    _, got = run(capsys, spark, "decontaminate", src, src, str(tmp_path / "k.jsonl"), str(tmp_path / "rem.jsonl"), "--ngram", "2")
    assert got["removed"] == len(ROWS)
    raw = write(tmp_path / "raw.jsonl", [{"id": "x", "pre_text": ["t"], "qa": {"question": "what?", "answer": "5"}}])
    _, got = run(capsys, spark, "normalize", raw, str(tmp_path / "n.jsonl"), "--source-split", "dev")
    assert got["rows"] == 1
    _, got = run(capsys, spark, "chat", src, str(tmp_path / "ch.jsonl"))
    assert got["records"] == len(ROWS)
    broken = tmp_path / "bad.jsonl"
    broken.write_text('{"id": "1"}\n{oops\n')
    with pytest.raises(ValueError, match="bad.jsonl:2"):
        main(["chat", str(broken), str(tmp_path / "x")], spark)


def test_config(capsys, monkeypatch):
    monkeypatch.delenv("LEDGERLOOM_MODEL_CALLS", raising=False)
    monkeypatch.setenv("LEDGERLOOM_API_KEY", "secret")
    assert main(["check-config"]) == 0
    said = capsys.readouterr().out
    got = json.loads(said.strip())
    assert not got["ready_for_model_calls"] and got["status"]["LEDGERLOOM_API_KEY"] == "present" and "secret" not in said
