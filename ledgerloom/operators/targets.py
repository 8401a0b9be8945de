"""Training targets from question records: building, validation, roll-ups and chat export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import exact_match, gold_text
from ledgerloom.functions.text import FORBIDDEN_IN_PROGRAM, lines, strip, text
from ledgerloom.operators import programs
from ledgerloom.operators.normalize import chat_messages
from ledgerloom.operators.prompts import DEFAULT, PromptSet, user_prompt
from ledgerloom.session import cut, pinned

#: Invalid rows that a validation report lists.
EXAMPLES = 20


def validate_programs(rows: DataFrame, column: str = "program") -> DataFrame:
    """``rows`` with a struct ``check``: program, one_line, executable, answer, trace, ops, steps, matches_gold, errors.

    Errors are named in a fixed order; those of parsing, running and comparing carry a
    reason after a colon.  A null or blank program is ``missing_program``.
    """
    raw = strip(text(F.col(column)))
    visible = F.size(F.filter(lines(raw), lambda x: strip(x) != ""))
    one_line = (raw != "") & (visible == 1)
    program = programs.normalize_program(raw)
    known = [*programs.lang.OPERATIONS]
    base = rows.withColumn("_program", program).withColumn("_run", programs.run_program(program))
    run = F.col("_run")
    executable = (F.col("_program") != "") & run["error"].isNull()
    gold = strip(text(F.col("gold")))
    match = exact_match(run["answer"], gold)
    outer = run["outer"]
    unknown = F.exists(outer, lambda o: ~o.isin(known))
    error = lambda name, cond: F.when(cond, F.lit(name) if isinstance(name, str) else name)
    errors = F.array_compact(
        F.array(
            error("missing_program", raw == ""),
            error("not_one_line", (raw != "") & ~one_line),
            error("contains_non_program_text", raw.rlike(FORBIDDEN_IN_PROGRAM)),
            error("unsupported_operation", (F.col("_program") != "") & unknown),
            error("parse_error:unsupported_program_sequence", (F.col("_program") != "") & ~run["supported"]),
            error(F.concat(F.lit("execution_error:"), run["error"]), (F.col("_program") != "") & run["error"].isNotNull()),
            error(F.concat(F.lit("gold_mismatch:"), match["reason"]), executable & (gold != "") & ~match["is_match"]),
        )
    )
    check = F.struct(
        F.col("_program").alias("program"),
        one_line.alias("one_line"),
        executable.alias("executable"),
        F.when(executable, run["answer"]).otherwise("").alias("answer"),
        F.when(executable, run["trace"]).otherwise("").alias("trace"),
        F.when(executable, run["ops"]).otherwise(outer).alias("ops"),
        F.when(executable, run["steps"]).otherwise(0).alias("steps"),
        (executable & (gold != "") & F.coalesce(match["is_match"], F.lit(False))).alias("matches_gold"),
        errors.alias("errors"),
    )
    return pinned(base, "check", check).drop("_program", "_run")


def _others(rows: DataFrame, *made: str) -> list[str]:
    """Columns of ``rows`` but those that are made anew, as rows may be targets already."""
    return [f"`{c}`" for c in rows.columns if c not in made]


def program_targets(rows: DataFrame) -> DataFrame:
    """Valid program rows with assistant_program, calculator_answer, calculator_trace, program_ops, program_step_count."""
    ok = validate_programs(rows).where(F.size("check.errors") == 0)
    return ok.select(
        *_others(rows, "assistant_program", "calculator_answer", "calculator_trace", "program_ops", "program_step_count"),
        F.col("check.program").alias("assistant_program"),
        F.col("check.answer").alias("calculator_answer"),
        F.col("check.trace").alias("calculator_trace"),
        F.col("check.ops").alias("program_ops"),
        F.col("check.steps").alias("program_step_count"),
    )


def with_tags(rows: DataFrame, out: str = "tags") -> DataFrame:
    """Program rows with their tags, ``general_program`` where none applies."""
    tags = programs.target_tags(
        F.col("assistant_program"),
        F.col("question"),
        F.col("context"),
        F.col("answer_type"),
        F.col("metadata.raw_table_rows"),
        F.col("program_ops"),
        F.col("program_step_count"),
    )
    tagged = pinned(rows, out, tags)
    return tagged.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.lit("general_program"))))


def source_targets(rows: DataFrame) -> DataFrame:
    """Program targets with source numbers, constants, operation class and the JSON target."""
    base = with_tags(program_targets(rows), "_tags")
    ops = programs.operand_lists(F.col("assistant_program"))
    base = base.withColumns(
        {
            "source_numbers": ops["source_numbers"],
            "program_constants": ops["constants"],
            "operation_class": programs.operation_class(F.col("program_ops"), F.col("_tags"), F.col("question"), F.col("answer_type")),
        }
    )
    target = F.to_json(
        F.struct("source_numbers", F.col("program_constants").alias("constants"), "operation_class", F.col("assistant_program").alias("program"))
    )
    base = base.withColumn("assistant_source_program", target).drop("source_program_tags")
    return base.withColumnRenamed("_tags", "source_program_tags")


def calculation_targets(rows: DataFrame) -> DataFrame:
    """Rows whose flat calculation matches the gold, with evidence hint, calculation and target text."""
    c = rows.withColumn("_calc", programs.calculate(F.col("program"), F.col("gold"))).where("_calc.matches")
    c = c.withColumn("evidence_hint", programs.evidence_hint(F.col("evidence")))
    final = F.concat(F.lit("Final answer: "), gold_text(F.col("gold"), F.col("answer_type")))
    kept = _others(rows, "evidence_hint", "calculation", "calculation_result", "assistant_target")
    c = c.select(*kept, "evidence_hint", F.col("_calc.trace").alias("calculation"), F.col("_calc.result").alias("calculation_result"), final.alias("_final"))
    thought = F.concat(F.lit("Evidence: "), F.col("evidence_hint"), F.lit("\nCalculation: "), F.col("calculation"))
    return c.select(
        *kept,
        "evidence_hint",
        "calculation",
        "calculation_result",
        F.concat(thought, F.lit("\n"), F.col("_final")).alias("assistant_target"),
    )


def reasoning_targets(rows: DataFrame) -> DataFrame:
    """Calculation targets with the answer line and the reasoning apart."""
    c = calculation_targets(rows)
    return c.withColumns(
        {
            "assistant_content": F.concat(F.lit("Final answer: "), gold_text(F.col("gold"), F.col("answer_type"))),
            "assistant_reasoning_content": F.concat(F.lit("Evidence: "), F.col("evidence_hint"), F.lit("\nCalculation: "), F.col("calculation")),
        }
    )


def _histogram(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """One row: a JSON object of how often each text of the arrays ``items`` occurs, counted by group before it is gathered."""
    counts = rows.select(F.explode(items).alias("k")).where("k is not null").groupBy("k").count()
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count"))))).alias(name))


def _examples(rows: DataFrame, key: str, errors: str, *more: str) -> DataFrame:
    """One row: the first ``EXAMPLES`` rows with errors, as JSON."""
    bad = rows.where(F.size(errors) > 0).select(F.col(key).cast("string").alias("id"), F.col(errors).alias("errors"), *more)
    first = bad.orderBy("id").limit(EXAMPLES)
    return first.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "errors", *more)))).alias("invalid_examples"))


def _beside(flags: DataFrame, *parts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    for p in parts:
        flags = flags.crossJoin(F.broadcast(p))
    return flags


def _column(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def program_report(rows: DataFrame, column: str = "assistant_program", key: str = "id") -> DataFrame:
    """One row: n, valid, invalid, the three rates, five histograms as JSON and the first invalid rows.

    ``rows`` may have ``targeted_program_tags`` and ``targeted_selection_bucket``; without
    them those histograms are empty.  Only ``EXAMPLES`` invalid rows are kept.
    """
    checked = cut(validate_programs(rows, column))
    flags = checked.agg(
        F.count("*").alias("n"),
        F.count_if(F.size("check.errors") == 0).alias("valid"),
        F.count_if(F.size("check.errors") > 0).alias("invalid"),
        F.coalesce(F.avg(F.col("check.one_line").cast("double")), F.lit(0.0)).alias("one_line_rate"),
        F.coalesce(F.avg(F.col("check.executable").cast("double")), F.lit(0.0)).alias("executable_rate"),
        F.coalesce(F.avg(F.col("check.matches_gold").cast("double")), F.lit(0.0)).alias("gold_match_rate"),
    )
    histograms = {
        "by_subtype": F.array(F.coalesce(F.col("subtype"), F.lit("unknown"))),
        "operations": F.col("check.ops"),
        "targeted_program_tags": _column(rows, "targeted_program_tags", "array<string>"),
        "targeted_selection_buckets": F.array(_column(rows, "targeted_selection_bucket")),
        "errors": F.transform("check.errors", lambda e: F.substring_index(e, ":", 1)),
    }
    listed = checked.withColumn("_errors", F.col("check.errors"))
    return _beside(flags, *[_histogram(checked, c, name) for name, c in histograms.items()], _examples(listed, key, "_errors"))


def source_report(rows: DataFrame, column: str = "assistant_source_program", key: str = "id") -> DataFrame:
    """One row: n, valid, invalid, rates, histograms of classes, number counts, tags and buckets, the first invalid rows.

    Rates of running and matching are those of rows whose embedded program is valid.
    """
    checked = cut(validate_source_targets(rows, column))
    n = F.count("*")
    good = F.size("check.errors") == 0
    part = lambda c: F.coalesce(F.try_divide(F.count_if(good & c).cast("double"), F.count_if(good).cast("double")), F.lit(0.0))
    flags = checked.agg(
        n.alias("n"),
        F.count_if(F.size("source_errors") == 0).alias("valid"),
        F.count_if(F.size("source_errors") > 0).alias("invalid"),
        F.coalesce(F.avg((~F.array_contains("source_errors", "not_one_line")).cast("double")), F.lit(0.0)).alias("json_one_line_rate"),
        part(F.col("check.executable")).alias("program_executable_rate"),
        part(F.col("check.matches_gold")).alias("program_gold_match_rate"),
    )
    histograms = {
        "operation_classes": F.array(F.coalesce(F.nullif(F.col("target_class"), F.lit("")), F.lit("unknown"))),
        "source_number_counts": F.array(F.col("target_numbers").cast("string")),
        "source_program_tags": _column(rows, "source_program_tags", "array<string>"),
        "source_program_selection_buckets": F.array(_column(rows, "source_program_selection_bucket")),
    }
    return _beside(flags, *[_histogram(checked, c, name) for name, c in histograms.items()], _examples(checked, key, "source_errors", column))


def validate_source_targets(rows: DataFrame, column: str = "assistant_source_program") -> DataFrame:
    """``rows`` with ``source_errors``: JSON shape, one line, embedded program, and agreement of its operands.

    ``target_class`` and ``target_numbers`` (a count) come out of the target too.
    """
    raw = strip(text(F.col(column)))
    schema = "source_numbers array<string>, constants array<string>, operation_class string, program string"
    parsed = F.from_json(raw, schema)
    read = F.struct(raw.alias("raw"), parsed.alias("t"), (F.is_valid_utf8(raw) & F.try_parse_json(raw).isNotNull()).alias("ok"))
    base = pinned(rows, "_read", read).withColumns({"_raw": F.col("_read.raw"), "_t": F.col("_read.t"), "_ok": F.col("_read.ok")}).drop("_read")
    base = base.withColumn("assistant_program", strip(text(F.col("_t.program"))))
    checked = validate_programs(base, "assistant_program")
    want = programs.operand_lists(F.col("assistant_program"))
    empty = F.array().cast("array<string>")
    error = lambda name, cond: F.when(cond, F.array(F.lit(name))).otherwise(empty)
    numbers, constants = F.coalesce("_t.source_numbers", empty), F.coalesce("_t.constants", empty)
    errors = F.concat(
        error("invalid_json", ~F.col("_ok")),
        error("target_not_object", F.col("_ok") & ~F.col("_raw").startswith("{")),
        error("missing_operation_class", F.coalesce(F.col("_t.operation_class"), F.lit("")) == ""),
        error("missing_program", F.col("assistant_program") == ""),
        error("not_one_line", F.col("_raw").rlike(r"[\r\n]")),
        error("contains_final_answer", F.col("_raw").contains("Final answer:")),
        F.transform("check.errors", lambda e: F.concat(F.lit("program_"), e)),
        error("source_numbers_do_not_match_program", numbers != want["source_numbers"]),
        error("constants_do_not_match_program", constants != want["constants"]),
    )
    told = {"source_errors": errors, "target_class": F.col("_t.operation_class"), "target_numbers": F.size(numbers)}
    return checked.withColumns(told).drop("_raw", "_t", "_ok")


class ValidationGate(ValueError):
    """A validation report missed its thresholds."""


def gate(report: DataFrame, max_errors: int = 0, min_match: float | None = 0.98) -> None:
    """Raise :class:`ValidationGate` where a report has too many invalid rows or too few matches (``None``: any)."""
    r = report.first().asDict()
    rate = r.get("gold_match_rate", r.get("program_gold_match_rate", 1.0))
    if r["invalid"] > max_errors or min_match is not None and rate < min_match:
        raise ValidationGate(f"{r['invalid']} invalid rows, match rate {rate:.4f}")


def answer_chat(rows: DataFrame, system: str = DEFAULT.answer_system, prefix: str = "Final answer:") -> DataFrame:
    """(id, messages): prompt and gold, the prefix put before golds that lack it."""
    gold = strip(text(F.col("gold")))
    answer = F.when(F.lower(gold).startswith(prefix.lower()), gold).otherwise(F.concat(F.lit(prefix + " "), gold))
    return rows.select("id", chat_messages(F.lit(system), F.col("prompt"), answer).alias("messages"))


def calculation_chat(rows: DataFrame, prompts: PromptSet = DEFAULT) -> DataFrame:
    return calculation_targets(rows).select(
        "id", chat_messages(F.lit(prompts.calculation_system), F.col("prompt"), F.col("assistant_target")).alias("messages")
    )


def reasoning_chat(rows: DataFrame, prompts: PromptSet = DEFAULT) -> DataFrame:
    return reasoning_targets(rows).select(
        "id",
        chat_messages(
            F.lit(prompts.reasoning_system), F.col("prompt"), F.col("assistant_content"), F.col("assistant_reasoning_content")
        ).alias("messages"),
    )


def program_chat(rows: DataFrame, no_think: bool = False, prompts: PromptSet = DEFAULT) -> DataFrame:
    user = user_prompt(F.col("context"), F.col("question"), prompts.program_task, None, no_think)
    return program_targets(rows).select("id", chat_messages(F.lit(prompts.program_system), user, F.col("assistant_program")).alias("messages"))


def source_chat(rows: DataFrame, no_think: bool = False, prompts: PromptSet = DEFAULT) -> DataFrame:
    user = user_prompt(F.col("context"), F.col("question"), prompts.source_task, None, no_think)
    return source_targets(rows).select(
        "id", chat_messages(F.lit(prompts.source_system), user, F.col("assistant_source_program")).alias("messages")
    )


def check_chat(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """``chats`` with ``chat_errors``: message count and roles, blank, several-line or other than program content, reasoning."""
    m = F.col(messages)
    three = F.coalesce(F.size(m), F.lit(0)) == 3
    last = F.get(m, F.lit(2))
    content = F.when(three, strip(text(last["content"]))).otherwise("")
    roles = F.array_join(F.transform(m, lambda x: x["role"]), ",")
    error = lambda name, cond: F.when(cond, F.lit(name))
    errors = F.array_compact(
        F.array(
            error("expected_three_messages", ~three),
            error("unexpected_message_roles", three & (roles != "system,user,assistant")),
            error("missing_assistant_content", content == ""),
            error("assistant_content_not_one_line", content.rlike(r"[\r\n]")),
            error("assistant_content_contains_non_program_text", content.rlike(r"(?i)final answer:|evidence:|calculation:|```")),
            error("assistant_contains_reasoning_content", three & last["reasoning_content"].isNotNull()),
        )
    )
    return chats.withColumn("chat_errors", errors)


def chat_report(chats: DataFrame, expected: int | None = None, key: str | None = None) -> DataFrame:
    """One row: n, valid, invalid, whether the count is the expected one, errors as a histogram, the first invalid records.

    Examples are named by ``key``, or by the order of the records.
    """
    c = check_chat(chats if key else chats.withColumn("_order", F.monotonically_increasing_id()))
    n = F.count("*")
    flags = c.agg(
        n.alias("n"),
        F.count_if(F.size("chat_errors") == 0).alias("valid"),
        F.count_if(F.size("chat_errors") > 0).alias("invalid"),
        (F.lit(True) if expected is None else n == expected).alias("count_ok"),
    )
    named = c.withColumn("_errors", F.col("chat_errors"))
    return _beside(flags, _histogram(c, F.col("chat_errors"), "errors"), _examples(named, key or "_order", "_errors"))
