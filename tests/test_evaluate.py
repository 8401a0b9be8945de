import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import generate as gen
from ledgerloom.operators import stats
from ledgerloom.plans import report

SCHEMA = "id string, n int, subtype string, context string, gold string, prediction string"


def run(spark, *predictions, gold="12"):
    rows = [(f"i{i}", i, "ratio" if i % 2 else None, "It rose by 12 and 13", gold, p) for i, p in enumerate(predictions)]
    return spark.createDataFrame(rows, SCHEMA)


def test_score_items(spark):
    got = ev.score_items(run(spark, "Final answer: 12", "12", "Final answer: 13", "Final answer: 99 and 12.0", None)).collect()
    assert [r.correct for r in got] == [True, False, False, True, False]
    assert [r.format_violation for r in got] == [False, True, False, False, True]
    assert [list(r.unsupported_numbers) for r in got] == [[], [], [], ["99"], []]
    assert got[0].subtype == "unknown"
    loose = ev.score_items(run(spark, "12"), require_final_answer=False).first()
    assert loose.correct and not loose.format_violation


def test_summary_and_comparison(spark):
    base = ev.score_items(run(spark, "Final answer: 12", "Final answer: 12", "Final answer: 5", "Final answer: 5"), keep=("id", "n"))
    new = ev.score_items(run(spark, "Final answer: 12", "Final answer: 5", "Final answer: 12", "Final answer: 12"), keep=("id", "n"))
    s = {r.subtype: r for r in ev.summarize(base).collect()}
    assert s[None].n == 4 and s[None].exact_match == 0.5 and s["ratio"].n == 2
    assert s[None].ci_low <= 0.5 <= s[None].ci_high
    c = ev.compare_runs(base, new, "n").first()
    assert (c.n_paired, c.paired_delta) == (4, 0.25) and c.delta_low < 0.25 < c.delta_high
    twice = base.union(base.withColumn("n", F.col("n") + 100).withColumn("correct", F.lit(False)))
    assert ev.compare_runs(twice, base, "n").first().paired_delta == 0.5
    empty = ev.compare_runs(base.limit(0), new, "n").first()
    assert (empty.n_paired, empty.paired_delta, empty.p_value) == (0, 0.0, 1.0)
    assert ev.summarize(base.limit(0)).where("overall = 1").count() in (0, 1)


def test_failure_pack_and_reports(spark, tmp_path):
    old = ev.score_items(run(spark, "Final answer: 12", "Final answer: 5", "Final answer: 13", "Final answer: 12"), keep=("id", "n"))
    new = ev.score_items(run(spark, "Final answer: 13", "Final answer: 77", "Final answer: not enough information", "Final answer: 12"), keep=("id", "n"))
    records = run(spark, None, None, None, None).select("id", "n", "context", "gold")
    pack = ev.failure_pack(records, {"old": old, "new": new}, "old", "new", "n")
    got = [(r.priority_rank, r.priority, r.id, r.transition, r.suggested_label) for r in pack.collect()]
    assert got[0] == (1, "yes", "i0", "regressed", "exact_match_regression")
    assert (3, "yes", "i1", "both_wrong", "unsupported_figure") in got
    assert (4, "no", "i2", "both_wrong", "unsupported_abstention") in got
    assert (5, "no", "i3", "both_correct", "correct") in got
    assert "regressed: 1" in report.render_pack(pack, "old", "new")
    runs = {"a": run(spark, "Final answer: 12", "5"), "b": run(spark, "Final answer: 12", "Final answer: 12")}
    payload = report.report_payload(runs, "n", "a")
    text = report.render(payload)
    assert "| a | 2 | 50.0% |" in text and "| a | b | 2 | +50.0 |" in text
    report.write_report(payload, str(tmp_path / "r" / "x.md"), str(tmp_path / "r" / "x.json"))
    report.write_report(payload, str(tmp_path / "r" / "x.md"))
    assert len(list((tmp_path / "r" / "archive").iterdir())) == 1
    with pytest.raises(ValueError):
        report.report_payload(runs, "n", "zz")


def test_mcnemar_and_kappa(spark):
    def p(a, b):
        return spark.createDataFrame([(a, b)], "a long, b long").select(stats.exact_pvalue(F.col("a"), F.col("b")).alias("p")).first().p

    def exact(a, b):
        n, k = a + b, min(a, b)
        return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    for a, b in ((4, 0), (0, 0), (3, 3), (10, 2), (700, 640), (1500, 1400)):
        assert p(a, b) == pytest.approx(exact(a, b), rel=1e-9)
    rng = random.Random(2)
    pairs = [(rng.choice("xyz"), rng.choice("xyz")) for _ in range(200)]
    k = stats.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    same = sum(a == b for a, b in pairs) / 200
    chance = sum(sum(a == v for a, _ in pairs) * sum(b == v for _, b in pairs) for v in "xyz") / 200**2
    assert k.kappa == pytest.approx((same - chance) / (1 - chance))
    df = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert stats.kappa(df, "a", "b").first().kappa == 1.0 and stats.kappa(df.limit(0), "a", "b").first().kappa == 0.0
    flags = spark.createDataFrame([(True, True), (True, False), (False, True), (False, True)], "a boolean, b boolean")
    assert stats.paired_counts(flags, "a", "b").first().delta == 0.25


def test_bootstrap(spark):
    values = [float(i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    r = stats.bootstrap_ci(df, "v", "k", 500).first()
    low, high = stats.parity_ci(values, 500)
    assert r.low < sum(values) / 60 < r.high and abs(r.low - low) < 0.06 and abs(r.high - high) < 0.06
    b = spark.createDataFrame([(60, 20)], "n long, h long").select(stats.binary_ci(F.col("n"), F.col("h")).alias("c")).first().c
    assert abs(b.low - low) < 0.06 and abs(b.high - high) < 0.06
    e = stats.bootstrap_ci(df.limit(0), "v", "k", 10).first()
    assert (e.low, e.high) == (0.0, 0.0) and stats.parity_ci([]) == (0.0, 0.0)
    for bad in (lambda: stats.bootstrap_ci(df, "v", "k", 0), lambda: stats.bootstrap_ci(df, "v", "k", 5, 1.5), lambda: stats.parity_ci([1.0], 0)):
        with pytest.raises(ValueError):
            bad()


def test_bootstrap_draws_stay_where_they_are_made(spark, capsys):
    values = [float(i * i % 7) - 2 for i in range(23)]
    df = spark.createDataFrame([(5 * i, v) for i, v in enumerate(values)], "k long, v double")
    found = stats.bootstrap_ci(df, "v", "k", 40)
    draw = lambda b, i: int(hashlib.md5(f"13:{b}:{i}".encode()).hexdigest()[:12], 16) % 23
    means = sorted(sum(values[draw(b, i)] for i in range(23)) / 23 for b in range(40))
    low, high = stats._bounds(40, 0.95)
    assert tuple(found.first()) == (23, pytest.approx(means[low]), pytest.approx(means[high]))
    found.explain()
    plan = capsys.readouterr().out
    # draws are summed by resample before any shuffle, and digested once
    assert not re.search(r"hashpartitioning\([^)]*\br#", plan) and plan.count("md5(") == 1


def test_judge(spark):
    rows = [("12", "13", "12", ""), ("99 5", "99", "7", "5"), ("x", "y", "7", ""), (None, "7", "7", None)]
    df = spark.createDataFrame(rows, "a string, b string, g string, c string")
    got = [r.j.winner for r in df.select(ev.judge(F.col("a"), F.col("b"), F.col("g"), F.col("c")).alias("j")).collect()]
    assert got == ["a", "tie", "tie", "b"]


RECORD = "id string, context string, question string, gold string, program string"


def test_offline_providers(spark):
    df = spark.createDataFrame([("a", "It was $10.0 in 2010", "q", "12.0", "add(1, 2)"), ("b", None, "q", None, "add(1")], RECORD)
    out = {p: [r.prediction for r in gen.generate(df, p).collect()] for p in gen.OFFLINE}
    assert out["offline_gold"] == ["Final answer: 12.0", "Final answer: "]
    assert out["offline_abstain"][0] == "Final answer: not enough information"
    assert out["offline_first_number"] == ["Final answer: $10.0", "Final answer: not enough information"]
    assert "messages" in gen.generate(df, "offline_gold", include_prompts=True).columns
    o = [(r.prediction, r.finish_reason) for r in gen.oracle_predictions(df).collect()]
    assert o == [("Final answer: 3", "calculator_stop"), ("Final answer: not enough information", "calculator_error")]
    replies = df.withColumn("r", F.when(F.col("id") == "a", "Program: add(1, 2)").otherwise("no idea"))
    got = [(r.predicted_program, r.finish_reason) for r in gen.plan_programs(replies, F.col("r"), "x", "m").collect()]
    assert got == [("add(1, 2)", "calculator_stop"), ("", "planner_parse_error")]
    bad = gen.plan_programs(replies, F.lit("divide(1, 0)"), "x", "m").first()
    assert bad.finish_reason == "calculator_error" and bad.prediction == gen.ABSTAIN
    assert gen.model_error_row(df, F.lit("boom"), "p", "m").first().finish_reason == "model_error"


def test_calls_are_gated(spark, monkeypatch):
    monkeypatch.delenv(gen.CALLS_ENV, raising=False)
    df = spark.createDataFrame([("a", "c", "q", "1", None)], RECORD)
    with pytest.raises(gen.CallsDisabled):
        gen.generate(df, "http")
    with pytest.raises(gen.CallsDisabled):
        gen.http_client("http://localhost", "k")("m", [])

    def client(model, messages):
        if "boom" in messages[1]["content"]:
            raise ValueError("boom")
        return {"model": model, "choices": [{"message": {"content": "Final answer: 1"}, "finish_reason": "stop"}]}

    two = df.union(spark.createDataFrame([("b", "boom", "q", "1", None)], RECORD))
    assert [r.prediction for r in gen.generate(two, "http", "m", client=client, on_error="skip").collect()] == ["Final answer: 1"]
    got = gen.generate(two, "http", "m", client=client, on_error="fallback").collect()
    assert [r.finish_reason for r in got] == ["stop", "model_error"]
    with pytest.raises(Exception, match="boom"):
        gen.generate(two, "http", "m", client=client).collect()


def test_retry_and_message_text():
    import urllib.error

    calls, slept = [], []

    def limited():
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "7"} if len(calls) == 1 else {}, None)
        return {"ok": True}

    assert gen.with_retry(limited, 4, 10, slept.append) == {"ok": True} and slept == [7.0, 20]
    with pytest.raises(urllib.error.HTTPError):
        gen.with_retry(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 500, "x", {}, None)), 4, 0, slept.append)
    assert gen.message_text({"content": "x"}) == "x"
    assert gen.message_text({"content": [{"text": "a"}, "b", None]}) == "a\nb"
    assert gen.message_text({"content": " ", "reasoning": "r"}) == "r" and gen.message_text({}) == ""


def test_select_rows(spark):
    df = spark.createDataFrame([("skip", 1), ("keep-1", 2), ("keep-2", 3)], "id string, o int")
    out = ev.select_rows(df, "o", 1, spark.createDataFrame([("skip",)], "id string"))
    assert [r.id for r in out.collect()] == ["keep-1"]
    values = spark.createDataFrame([(2, "m"), (1, ""), (3, "z")], "o int, model string")
    assert ev.first_present(values, "model", "o").first().model == "m"
    assert ev.first_present(values.limit(0), "model", "o").first().model == "unknown"
