import random
from decimal import Decimal, getcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import program as lang
from ledgerloom.operators import programs


@pytest.mark.parametrize(
    "text,answer,steps",
    [
        ("divide(subtract(12.0, 10.0), 10.0)", "0.2", 2),
        ("add(9.17, 3.55), divide(#0, const_2)", "6.36", 2),
        ("multiply(21, 28%)", "5.88", 1),
        ("greater(5941210, 4852978)", "yes", 1),
        ("greater(1, 10)", "no", 1),
        ("add(const_1, 2.0%), exp(#0, 7), multiply(397, #1)", "456.02821", 3),
        ("table_max(1, 4, -2)", "4", 1),
        ("table_average(1, 2, 6)", "3", 1),
        ("subtract(5, (3))", "8", 1),
        ("add(add(1, 2), add(3, 4)), multiply(#2, #0)", "30", 4),
        ("add(const_m1, 1)", "0", 1),
        ("subtract(0.0000001, 0.0000002)", "0", 1),
    ],
)
def test_runs(text, answer, steps):
    run = lang.execute(text)
    assert (run.answer, len(run.steps)) == (answer, steps)


def test_trace():
    assert lang.execute("divide(558360, 531822)").trace == "558360 / 531822 = 1.0499"
    assert lang.execute("subtract(150, -233)").trace == "150 - (-233) = 383"


@pytest.mark.parametrize(
    "text",
    ["", None, "table_max(row name, none)", "add(1", "divide(1, 0)", "foo(1)", "subtract(1)", "add(#0, 1)", "greater(2, 1), add(#0, 1)",
     "add(1, 2) x", "3", "exp(10, 40)", "add(1, 2))", "table_max()", "#0", "exp(0, -1)", "exp(-8, 0.5)"],
)
def test_errors(text):
    with pytest.raises(lang.ProgramError):
        lang.execute(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-9999, 9999), min_size=2, max_size=5), st.sampled_from(["add", "multiply", "table_sum", "table_min"]))
def test_against_python(values, op):
    got = lang.execute(f"{op}({', '.join(map(str, values))})").value
    want = {"add": sum, "table_sum": sum, "table_min": min, "multiply": lambda v: __import__("math").prod(v)}[op](values)
    assert got == Decimal(want)


def test_operands_and_names():
    assert lang.operands("subtract(85.00, const_100), divide(#0, const_100)") == (["85.00"], ["const_100"])
    assert lang.operation_names("subtract(1, 2), divide(add(1, 2), 3)") == ["subtract", "divide"]


def test_extract_program():
    extract = programs.extract_program
    assert extract("divide(1,2)") == "divide(1, 2)"
    assert extract("Program: add( 1 , 2 ),divide(#0, 3)") == "add(1, 2), divide(#0, 3)"
    assert extract("Plan\n```text\nsubtract(5, 3)\n```\nas shown (above)") == "subtract(5, 3)"
    assert extract("add(1, 2) (see note)") == "add(1, 2)"
    assert extract("no plan here") is None
    assert extract(None) is None


def test_flat_calculator():
    value, trace = programs.flat_run("subtract(150, -233)")
    assert value == 383 and "150 - (-233) = 383" in trace
    assert programs.value_matches_gold(programs.flat_run("divide(9896, 23.6%)")[0], "41932.20339")
    assert programs.flat_run("greater(1, 2)") is None and programs.flat_run("") is None and programs.flat_run("divide(1, 0)") is None


def test_columns_agree_with_scanner(spark):
    rng = random.Random(3)
    ops = ["add", "subtract", "divide", "multiply"]
    texts = [f"{rng.choice(ops)}({rng.randint(1, 99)}, {rng.choice(['const_2', '7', '3.5'])}), {rng.choice(ops)}(#0, 4)" for _ in range(40)]
    texts += ["", None, "divide(subtract(3, 1), 2)", "broken(1"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "p string")
    rows = df.select("p", programs.operand_lists(F.col("p")).alias("o"), programs.program_ops(F.col("p")).alias("n"), programs.run_program(F.col("p")).alias("r")).collect()
    for r in rows:
        numbers, constants = lang.operands(r.p)
        assert (list(r.o.source_numbers), list(r.o.constants)) == (numbers, constants)
        if r.p and r.p.endswith(")"):
            assert list(r.n) == lang.operation_names(r.p)
        try:
            assert r.r.answer == lang.execute(r.p).answer and r.r.error is None
        except lang.ProgramError:
            assert r.r.answer is None and r.r.error


def test_decimal_context_is_left_alone():
    before = getcontext().prec
    lang.execute("divide(1, 3)")
    assert getcontext().prec == before


@pytest.mark.parametrize(
    "program,ops",
    [
        ("divide(add(add(add(add(add(1,2),3),4),5),6),7)", ["divide"]),
        ("add(" * 10 + "1" + ", 2)" * 10 + ", Subtract(#9, (3))", ["add", "subtract"]),
        ("subtract(1, 2), divide(#0, add(1, 2))", ["subtract", "divide"]),
        ("add(1, 2", []),
        ("add(1, 2))", []),
        (")add(", []),
        ("12", []),
        ("", []),
        (None, []),
    ],
)
def test_outermost_operations(spark, program, ops):
    got = spark.createDataFrame([(program,)], "p string").select(programs.program_ops(F.col("p")).alias("o")).first().o
    assert got == ops and lang.operation_names(program) == ops
