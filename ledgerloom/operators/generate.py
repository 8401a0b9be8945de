"""Predictions: offline providers as columns, model calls per partition, program planners."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import extract_numbers
from ledgerloom.operators.programs import extract_program_column, run_program
from ledgerloom.operators.prompts import answer_prompt, program_prompt, source_prompt

#: Set to 1 to allow calls that may cost money.
CALLS_ENV = "LEDGERLOOM_MODEL_CALLS"
KEY_ENV, URL_ENV = "LEDGERLOOM_API_KEY", "LEDGERLOOM_BASE_URL"
ABSTAIN = "Final answer: not enough information"


class CallsDisabled(RuntimeError):
    """Model calls are not allowed in this environment."""


def ensure_calls_enabled() -> None:
    """Raise :class:`CallsDisabled` unless the environment allows model calls."""
    if os.environ.get(CALLS_ENV) != "1":
        raise CallsDisabled(f"model calls are disabled; set {CALLS_ENV}=1 to allow them")


def first_number(c: Column) -> Column:
    """Surface of the first number in a text, null where there is none."""
    return F.get(extract_numbers(c), F.lit(0))["surface"]


# The providers that need no network.
OFFLINE: dict[str, Callable[[], Column]] = {
    "offline_gold": lambda: F.concat(F.lit("Final answer: "), F.coalesce("gold", F.lit(""))),
    "offline_abstain": lambda: F.lit(ABSTAIN),
    "offline_first_number": lambda: F.concat(F.lit("Final answer: "), F.coalesce(first_number(F.col("context")), F.lit("not enough information"))),
}
COPIED = ["id", "dataset", "source_split", "subtype", "answer_type", "context", "question", "gold"]


def _copied(rows: DataFrame) -> list[Column]:
    return [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COPIED]


def generate(rows: DataFrame, provider: str, model: str = "offline", include_prompts: bool = False, no_think: bool = False, **call) -> DataFrame:
    """Prediction rows of a provider; offline ones are expressions, others are called per partition."""
    messages = answer_prompt(F.col("context"), F.col("question"), None, no_think)
    extra = [messages.alias("messages")] if include_prompts else []
    if provider in OFFLINE:
        return rows.select(
            *_copied(rows),
            F.lit(model).alias("model"),
            F.lit(provider).alias("provider"),
            OFFLINE[provider]().alias("prediction"),
            F.lit(provider).alias("finish_reason"),
            F.to_json(F.struct(F.lit(provider).alias("provider"))).alias("provider_metadata"),
            *extra,
        )
    asked = rows.select(*_copied(rows), messages.alias("messages"))
    out = complete(asked, model, provider=provider, **call)
    return out if include_prompts else out.drop("messages")


def plan_programs(rows: DataFrame, reply: Column, provider: str, model: str) -> DataFrame:
    """Prediction rows from planner replies: extract a program, run it, fall back to abstaining."""
    base = rows.withColumn("planner_prediction_raw", reply)
    base = base.withColumn("predicted_program", extract_program_column(F.col("planner_prediction_raw")))
    base = base.withColumn("_run", run_program(F.col("predicted_program")))
    found, ran = F.col("predicted_program").isNotNull(), F.col("_run.error").isNull()
    ok = found & ran
    note = F.struct(
        F.lit("model_program").alias("planner"),
        F.when(ok, F.col("_run.trace")).alias("trace"),
        F.when(ok, F.col("_run.steps")).alias("step_count"),
        F.when(~found, "no program found").when(~ran, F.col("_run.error")).alias("error"),
    )
    return base.select(
        *_copied(rows),
        F.col("program").alias("gold_program"),
        F.lit(model).alias("model"),
        F.lit(f"{provider}_program_planner").alias("provider"),
        F.when(ok, F.concat(F.lit("Final answer: "), F.col("_run.answer"))).otherwise(ABSTAIN).alias("prediction"),
        "planner_prediction_raw",
        F.coalesce("predicted_program", F.lit("")).alias("predicted_program"),
        F.when(ok, "calculator_stop").when(found, "calculator_error").otherwise("planner_parse_error").alias("finish_reason"),
        F.to_json(note).alias("provider_metadata"),
    )


def oracle_predictions(rows: DataFrame, column: str = "program", model: str = "gold-program-calculator") -> DataFrame:
    """The gold program as the plan: its answer, or abstaining where it cannot run."""
    base = rows.withColumn("_run", run_program(F.col(column)))
    ok = F.col("_run.error").isNull()
    note = F.struct(
        F.lit("gold_program_oracle").alias("planner"),
        F.col(column).alias("program"),
        F.col("_run.trace").alias("trace"),
        F.when(ok, F.col("_run.steps")).alias("step_count"),
        F.col("_run.error").alias("error"),
    )
    return base.select(
        *_copied(rows),
        F.lit(model).alias("model"),
        F.lit("oracle_planner_calculator").alias("provider"),
        F.when(ok, F.concat(F.lit("Final answer: "), F.col("_run.answer"))).otherwise(ABSTAIN).alias("prediction"),
        F.when(ok, "calculator_stop").otherwise("calculator_error").alias("finish_reason"),
        F.to_json(note).alias("provider_metadata"),
    )


def model_error_row(rows: DataFrame, error: Column, provider: str, model: str) -> DataFrame:
    """Fallback prediction rows for rows whose model call failed."""
    return rows.select(
        *_copied(rows),
        F.lit(model).alias("model"),
        F.lit(provider).alias("provider"),
        F.lit(ABSTAIN).alias("prediction"),
        F.lit("model_error").alias("finish_reason"),
        F.to_json(F.struct(error.cast("string").alias("error"))).alias("provider_metadata"),
    )


def message_text(message: dict) -> str:
    """Text of a chat message: its content, the parts of a list, else reasoning or refusal."""
    content = message.get("content")
    if isinstance(content, list):
        parts = [(x.get("text") or x.get("content")) if isinstance(x, dict) else x for x in content]
        content = "\n".join(str(p) for p in parts if p)
    for t in (content, *(message.get(k) for k in ("reasoning_content", "reasoning", "refusal"))):
        if isinstance(t, str) and t.strip():
            return t
    return ""


def http_client(url: str, key: str, timeout: float = 60, **options) -> Callable[[str, list], dict]:
    """A client of the public chat-completions protocol: (model, messages) to the decoded response."""

    def call(model: str, messages: list) -> dict:
        ensure_calls_enabled()
        body = json.dumps({"model": model, "messages": messages, **{k: v for k, v in options.items() if v is not None}}).encode()
        request = urllib.request.Request(
            url.rstrip("/") + "/chat/completions",
            data=body,
            headers={"Authorization": f"Bearer {key}", "Content-Type": "application/json"},
        )
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.loads(response.read())

    return call


def with_retry(call: Callable[[], dict], retries: int = 4, pause: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Repeat a call that is rate limited, after the server's delay or a linearly growing one."""
    for attempt in range(retries + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == retries:
                raise
            after = (e.headers.get("Retry-After") if e.headers else None) or ""
            sleep(float(after) if after.replace(".", "", 1).isdigit() and float(after) > 0 else pause * (attempt + 1))
    raise AssertionError


def complete(
    rows: DataFrame,
    model: str,
    provider: str = "http",
    client: Callable[[str, list], dict] | None = None,
    on_error: str = "raise",
    retries: int = 4,
    pause: float = 10.0,
    **options,
) -> DataFrame:
    """Call a model for each row's ``messages``; one client per task, one call at a time in each.

    ``on_error`` is ``raise``, ``skip`` (no row) or ``fallback`` (a row that abstains).
    """
    if client is None:
        ensure_calls_enabled()
        url, key = os.environ.get(URL_ENV), os.environ.get(KEY_ENV)
        if not url or not key:
            raise RuntimeError(f"set {URL_ENV} and {KEY_ENV}")
        client = http_client(url, key, **options)
    names = [c for c in rows.columns if c != "messages"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                messages = [dict(m) for m in row["messages"]]
                try:
                    r = with_retry(lambda m=messages: client(model, m), retries, pause)
                    choice = r["choices"][0]
                    note = {"provider": provider, "usage": r.get("usage", {})}
                    got = (r.get("model", model), message_text(choice.get("message", {})), str(choice.get("finish_reason", "")), note)
                except Exception as e:
                    if on_error == "raise":
                        raise
                    if on_error == "skip":
                        continue
                    got = (model, ABSTAIN, "model_error", {"error": str(e)})
                out.append([row[c] for c in names] + [messages, got[0], provider, got[1], got[2], json.dumps(got[3])])
            yield pd.DataFrame(out, columns=[*names, "messages", "model", "provider", "prediction", "finish_reason", "provider_metadata"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*names, "messages"])
    return rows.mapInPandas(run, schema + ", model string, provider string, prediction string, finish_reason string, provider_metadata string")


def planner_prompts(rows: DataFrame, source: bool = False, no_think: bool = False) -> DataFrame:
    """Rows with the messages that ask for a program or for source figures and a program."""
    ask = source_prompt if source else program_prompt
    return rows.withColumn("messages", ask(F.col("context"), F.col("question"), no_think))
