"""Prompts for answers and programs, as Column expressions over question records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip, text

NO_THINK = "/no_think"


@dataclass(frozen=True)
class PromptSet:
    """Wording of the prompts; every text is a parameter."""

    answer_system: str = "Answer questions about financial reports from the given context alone, in one line."
    answer_task: str = "Reply with one line that starts with `Final answer:` and holds a number, a short phrase, or: not enough information."
    program_system: str = "Plan the calculation for a question about a financial report and write it as one program line."
    program_task: str = (
        "Write one line with a program and nothing else. Operations: add, subtract, multiply, divide, exp, greater, "
        "table_sum, table_average, table_max, table_min. Copy figures from the context, write constants as const_n and "
        "earlier results as #0, #1 and so on."
    )
    source_system: str = "Choose the source figures for a question about a financial report, name the operation, and write the program."
    source_task: str = (
        "Write one JSON object on one line with the keys source_numbers, constants, operation_class and program; "
        "no other text."
    )
    calculation_system: str = "Show the evidence and one short calculation from the context, then a line that starts with `Final answer:`."
    reasoning_system: str = "Think through evidence and calculation silently, then reply with one line that starts with `Final answer:`."
    extra: dict[str, str] = field(default_factory=dict)


DEFAULT = PromptSet()


def user_prompt(context: Column, question: Column, task: str, hint: Column | None = None, no_think: bool = False) -> Column:
    """Context, question and task; a program hint and the no-think mark where asked for."""
    parts = [F.lit("Context:"), strip(text(context)), F.lit(""), F.concat(F.lit("Question: "), strip(text(question))), F.lit(""), F.lit(task)]
    if hint is not None:
        parts.append(F.when(text(hint) != "", F.concat(F.lit("\nReasoning program hint: "), hint)))
    if no_think:
        parts.append(F.lit("\n" + NO_THINK))
    return strip(F.concat_ws("\n", *parts))


def prompt_messages(system: Column, user: Column) -> Column:
    """System and user message."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))
    )


def answer_prompt(
    context: Column, question: Column, program: Column | None = None, no_think: bool = False, prompts: PromptSet = DEFAULT
) -> Column:
    return prompt_messages(F.lit(prompts.answer_system), user_prompt(context, question, prompts.answer_task, program, no_think))


def program_prompt(context: Column, question: Column, no_think: bool = False, prompts: PromptSet = DEFAULT) -> Column:
    return prompt_messages(F.lit(prompts.program_system), user_prompt(context, question, prompts.program_task, None, no_think))


def source_prompt(context: Column, question: Column, no_think: bool = False, prompts: PromptSet = DEFAULT) -> Column:
    return prompt_messages(F.lit(prompts.source_system), user_prompt(context, question, prompts.source_task, None, no_think))
