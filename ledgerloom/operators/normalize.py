"""Raw nested records to flat question records, and chat records from those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import BARE_ABSTENTION, first_text, strip, text

# Patterns by which answers and questions are classified.
OPERATION = r"(?i)\b(add|subtract|multiply|divide|exp|greater|table_sum|table_average|table_max|table_min)\s*\("
RATIO_WORD = r"(?i)\b(percent|percentage|ratio|margin|rate|yield|per share|bps|basis point|growth)\b"
CURRENCY_WORD = r"(?i)[$€£]|\b(dollars?|usd|million|billion|thousand)\b"
PERCENT_WORD = r"(?i)%|\b(percent|percentage|basis points?|bps)\b"


def string_list(c: Column) -> Column:
    """Stripped elements that are not blank; an empty array for null."""
    return F.coalesce(F.filter(F.transform(c, lambda x: strip(text(x))), lambda x: x != ""), F.array().cast("array<string>"))


def table_text(table: Column) -> Column:
    """Stripped cells joined by `` | ``, rows by line breaks; blank rows are dropped, null cells are empty."""
    rows = F.transform(F.filter(table, lambda r: r.isNotNull()), lambda r: F.array_join(F.transform(r, lambda x: strip(text(x))), " | "))
    return F.coalesce(F.array_join(F.filter(rows, lambda r: strip(r) != ""), "\n"), F.lit(""))


def context_text(pre: Column, table: Column, post: Column) -> Column:
    """Sections ``Pre-text``, ``Table`` and ``Post-text``, those without content left out."""
    before, after, rows = string_list(pre), string_list(post), table_text(table)
    section = lambda name, body, full: F.when(full, F.concat(F.lit(f"{name}:\n"), body))
    return strip(
        F.concat_ws(
            "\n\n",
            section("Pre-text", F.array_join(before, "\n"), F.size(before) > 0),
            section("Table", rows, rows != ""),
            section("Post-text", F.array_join(after, "\n"), F.size(after) > 0),
        )
    )


def prompt_text(context: Column, question: Column) -> Column:
    return strip(F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question))


def answer_type(gold: Column, question: Column) -> Column:
    """``percent``, ``currency``, ``number`` or ``text``; digits count in the gold only."""
    both = F.concat_ws(" ", text(gold), text(question))
    return (
        F.when(both.rlike(PERCENT_WORD), "percent")
        .when(both.rlike(CURRENCY_WORD), "currency")
        .when(text(gold).rlike(r"(?U)\d"), "number")
        .otherwise("text")
    )


def subtype(question: Column, program: Column, gold: Column) -> Column:
    """``unanswerable``, ``ratio``, ``multi_step``, ``arithmetic`` or ``lookup``."""
    p = text(program)
    ops = F.size(F.regexp_extract_all(p, F.lit(OPERATION), 0))
    return (
        F.when(text(gold).rlike(BARE_ABSTENTION), "unanswerable")
        .when(F.concat_ws(" ", text(question), p).rlike(RATIO_WORD) | F.lower(p).contains("divide("), "ratio")
        .when(ops >= 2, "multi_step")
        .when(ops == 1, "arithmetic")
        .otherwise("lookup")
    )


def _field(df: DataFrame, *path: str) -> Column:
    """A possibly missing (nested) column; null where the schema lacks it."""
    kind: T.DataType = df.schema
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return F.lit(None).cast("string")
        kind = kind[name].dataType
    return F.col(".".join(f"`{p}`" for p in path))


def _array(df: DataFrame, name: str, of: str) -> Column:
    c = _field(df, name)
    kind = df.schema[name].dataType if name in df.columns else T.StringType()
    if isinstance(kind, T.ArrayType):
        return c
    return F.when(c.isNotNull(), F.array(c.cast("string") if of == "string" else F.array(c.cast("string"))))


def normalize_records(records: DataFrame, source_split: str = "unknown", dataset: str = "finqa", keep: tuple[str, ...] = ()) -> DataFrame:
    """Twelve-field records plus ``error``: null, or the first field that a record lacks.

    Missing ids, questions, golds and contexts are ``missing_id`` and so on; such rows are
    kept for a quarantine instead of failing the job.  Optional columns may be absent.
    Extra columns named in ``keep`` are carried over.
    """
    qa = lambda name: _field(records, "qa", name)
    top = lambda name: _field(records, name)
    inner = records.schema["qa"].dataType if "qa" in records.columns else None
    known = inner.fieldNames() if isinstance(inner, T.StructType) else []
    if "gold_inds" not in known:
        inds = F.lit(None).cast("array<string>")
    elif isinstance(inner["gold_inds"].dataType, T.ArrayType):
        inds = qa("gold_inds").cast("array<string>")
    else:
        inds = F.when(qa("gold_inds").isNotNull(), F.array(qa("gold_inds").cast("string")))
    table = _array(records, "table", "rows")
    question = first_text(qa("question"), top("question"))
    gold = first_text(
        *[qa(n) for n in ("exe_ans", "answer", "gold", "gold_answer", "final_answer")], *[top(n) for n in ("exe_ans", "answer", "gold")]
    )
    program = first_text(qa("program"), qa("program_re"))
    built = context_text(_array(records, "pre_text", "string"), table, _array(records, "post_text", "string"))
    base = records.select(
        *keep,
        first_text(top("id"), top("uid"), top("example_id")).alias("id"),
        F.lit(dataset).alias("dataset"),
        F.lit(source_split).alias("source_split"),
        F.when(built != "", built).otherwise(first_text(top("context"), top("text"))).alias("context"),
        question.alias("question"),
        gold.alias("gold"),
        program.alias("program"),
        F.coalesce(inds, F.array().cast("array<string>")).alias("evidence"),
        top("filename").alias("filename"),
        F.coalesce(F.when(table.isNotNull(), F.size(table)), F.lit(0)).alias("raw_table_rows"),
    )
    error = (
        F.when(F.col("id") == "", "missing_id")
        .when(F.col("question") == "", "missing_question")
        .when(F.col("gold") == "", "missing_gold")
        .when(F.col("context") == "", "missing_context")
    )
    return base.select(
        *keep,
        "id",
        "dataset",
        "source_split",
        subtype(F.col("question"), F.col("program"), F.col("gold")).alias("subtype"),
        answer_type(F.col("gold"), F.col("question")).alias("answer_type"),
        "context",
        "question",
        "gold",
        prompt_text(F.col("context"), F.col("question")).alias("prompt"),
        "program",
        "evidence",
        F.struct("filename", "raw_table_rows", (F.col("program") != "").alias("has_program")).alias("metadata"),
        error.alias("error"),
    )


def require_complete(normalized: DataFrame) -> DataFrame:
    """The records without ``error``; the job fails on the first incomplete one."""
    fail = F.raise_error(F.concat(F.lit("record "), F.col("id"), F.lit(": "), F.col("error")))
    return normalized.withColumn("id", F.when(F.col("error").isNull(), F.col("id")).otherwise(fail)).drop("error")


_MESSAGE = "array<struct<role: string, content: string, reasoning_content: string>>"


def chat_messages(system: Column, user: Column, assistant: Column, reasoning: Column | None = None) -> Column:
    """Three messages; ``reasoning_content`` of the last is null unless it has content."""
    message = lambda role, content, r=None: F.struct(
        F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast("string") if r is None else r).alias("reasoning_content")
    )
    thought = None if reasoning is None else F.when(reasoning != "", reasoning)
    return F.array(message("system", system), message("user", user), message("assistant", assistant, thought)).cast(_MESSAGE)
