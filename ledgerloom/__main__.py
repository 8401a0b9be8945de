"""Command line: ``python -m ledgerloom <command>``; each command prints one JSON object.

Inputs are JSON-lines files or folders of them, outputs folders of part files; what was at
an output is archived first.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import builders, decontaminate, evaluate, generate, normalize, sampling, targets
from ledgerloom.plans import report
from ledgerloom.session import build_session
from ledgerloom.sources import files

#: What a record must hold for the commands below; absent columns are read as null.
RECORD = (
    "id string, dataset string, source_split string, subtype string, answer_type string, context string, question string, gold string, "
    "prompt string, program string, evidence array<string>, metadata struct<filename: string, raw_table_rows: int, has_program: boolean>"
)
BUILT = RECORD + (
    ", assistant_program string, calculator_answer string, calculator_trace string, program_ops array<string>, program_step_count int, "
    "targeted_program_tags array<string>, targeted_selection_bucket string, assistant_source_program string, "
    "source_program_tags array<string>, source_program_selection_bucket string"
)
CHAT = "id string, messages array<struct<role: string, content: string, reasoning_content: string>>"
PREDICTION = RECORD + ", model string, provider string, prediction string, finish_reason string"
REPORT_JSON = ("by_subtype", "operations", "errors", "invalid_examples", "targeted_program_tags", "targeted_selection_buckets",
               "operation_classes", "source_number_counts", "source_program_tags", "source_program_selection_buckets")


def _rows(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return files.with_order(files.require_jsonl(spark, path, schema))


def _ids(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    found = None
    for p in paths:
        part = files.require_jsonl(spark, p, "id string").where("id is not null")
        found = part if found is None else found.union(part)
    return None if found is None else found.distinct()


def _counts(rows: DataFrame, column: str) -> dict[str, int]:
    counted = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("k")).count()
    return {r.k: r["count"] for r in counted.collect()}


def _report(frame: DataFrame) -> dict:
    row = frame.first().asDict()
    return {k: json.loads(v) if k in REPORT_JSON and v is not None else v for k, v in row.items()}


def normalize_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = files.load_records(spark, a.input, a.source_split, limit=a.limit)
    rows = normalize.require_complete(rows).orderBy(files.ORDER).drop(files.ORDER)
    old = files.write_jsonl(rows, a.output, keep_old=True)
    out = files.read_jsonl(spark, a.output, RECORD)
    return {"archived_previous": old, "output": a.output, "rows": out.count(), "by_subtype": _counts(out, "subtype")}


def split_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    ratios = {"train": a.train, "validation": a.validation, "test": a.test}
    parts = sampling.stratified_split(_rows(spark, a.input), a.stratify_field, files.ORDER, ratios, a.seed, "_split")
    parts = parts.persist()
    counts = {}
    for name in ratios:
        mine = parts.where(F.col("_split") == name).drop("_split", files.ORDER)
        files.write_jsonl(mine, f"{a.output_dir}/{name}.jsonl", keep_old=True)
        counts[name] = mine.count()
    return {"output_dir": a.output_dir, "rows": counts}


def decontaminate_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows, held = _rows(spark, a.candidates), _rows(spark, a.protected)
    found = decontaminate.decontaminate(rows, held, files.ORDER, a.text_field, a.id_field, a.text_field, a.ngram, a.threshold).persist()
    judged = rows.join(found, files.ORDER)
    files.write_jsonl(judged.where("not removed").select(*[c for c in rows.columns if c != files.ORDER]), a.kept, keep_old=True)
    removed = judged.where("removed").select(F.col(a.id_field).alias("id"), "max_overlap", F.col("matched_item").alias("matched_id"))
    files.write_jsonl(removed, a.report, keep_old=True)
    n = found.agg(F.count("*").alias("n"), F.count_if("removed").alias("r")).first()
    return {"input": n.n, "kept": n.n - n.r, "removed": n.r, "ngram": a.ngram, "threshold": a.threshold}


def chat_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    chats = targets.answer_chat(_rows(spark, a.input), prefix="" if a.no_prefix else "Final answer:")
    old = files.write_jsonl(chats.select("messages"), a.output, keep_old=True)
    return {"archived_previous": old, "output": a.output, "records": chats.count()}


def build_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows, kind = _rows(spark, a.input).drop(files.ORDER), a.kind
    exclude = _ids(spark, a.exclude)
    make = {"calculation": builders.calculation_set, "reasoning": builders.reasoning_set, "program": builders.program_set,
            "targeted": builders.targeted_set, "source": builders.source_set}[kind]
    more = {k: v for k, v in (("total", a.total), ("seed", a.seed)) if v is not None}
    if kind in ("program", "targeted", "source"):
        more["exclude"] = exclude
    chosen = make(rows, **more).persist()
    chat = {"calculation": lambda: targets.calculation_chat(rows=chosen), "reasoning": lambda: targets.reasoning_chat(chosen),
            "source": lambda: targets.source_chat(chosen, a.no_think)}.get(kind, lambda: targets.program_chat(chosen, a.no_think))()
    old_rows = files.write_jsonl(chosen, a.output, keep_old=True)
    old_chat = files.write_jsonl(chat.select("messages"), a.chat, keep_old=True)
    out = {
        "archived_previous": {"output": old_rows, "chat_output": old_chat},
        "by_subtype": _counts(chosen, "subtype"),
        "chat_output": a.chat,
        "excluded_ids": 0 if exclude is None else exclude.count(),
        "output": a.output,
        "selected": chosen.count(),
    }
    if kind in ("program", "targeted"):
        out["validation"] = {k: v for k, v in _report(targets.program_report(chosen)).items() if k.endswith("_rate") or k == "invalid"}
    if kind == "targeted":
        out["by_bucket"] = _counts(chosen, "targeted_selection_bucket")
    if kind == "source":
        out["by_bucket"] = _counts(chosen, "source_program_selection_bucket")
        out["validation"] = {k: v for k, v in _report(targets.source_report(chosen)).items() if k.endswith("_rate") or k == "invalid"}
    return out


def validate_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _rows(spark, a.input, BUILT)
    made = targets.program_report(rows, a.field) if a.kind == "program" else targets.source_report(rows)
    out = _report(made)
    failed = out["invalid"] > a.max_errors or a.kind == "program" and out["gold_match_rate"] < a.min_match_rate
    if a.chat:
        out["chat"] = _report(targets.chat_report(files.require_jsonl(spark, a.chat, CHAT), out["n"]))
        failed = failed or out["chat"]["invalid"] > a.max_errors
    if a.report:
        files.write_text(a.report, json.dumps(out, indent=2, sort_keys=True) + "\n")
    a.code = 1 if failed else 0
    return out


def predict_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = evaluate.select_rows(_rows(spark, a.input), files.ORDER, a.limit, spark.createDataFrame([(x,) for x in a.exclude_id], "id string") if a.exclude_id else None)
    if a.resume and files.exists(a.output):
        rows = builders.without(rows, files.read_jsonl(spark, a.output, "id string"))
    call = {} if a.provider in generate.OFFLINE else {"on_error": "skip" if a.continue_on_error else "raise", "retries": a.retries, "temperature": a.temperature, "max_tokens": a.max_tokens}
    out = generate.generate(rows, a.provider, a.model, a.include_prompts, a.no_think, **call)
    if a.resume:
        return {"output": a.output, "appended": files.append_new(out, a.output)}
    old = files.write_jsonl(out, a.output, keep_old=True)
    return {"archived_previous": old, "output": a.output, "rows": files.read_jsonl(spark, a.output, "id string").count()}


def plan_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Programs out of model replies: of a file of replies (id, reply), or of calls to a model."""
    rows = evaluate.select_rows(_rows(spark, a.input), files.ORDER, a.limit)
    if a.replies:
        asked = rows.join(files.require_jsonl(spark, a.replies, "id string, reply string"), "id")
    else:
        messages = generate.planner_prompts(rows, a.source, a.no_think).select("id", "messages")
        asked = rows.join(generate.complete(messages, a.model, on_error="fallback").select("id", F.col("prediction").alias("reply")), "id")
    out = generate.plan_programs(asked, F.col("reply"), "replies" if a.replies else "http", a.model)
    old = files.write_jsonl(out, a.output, keep_old=True)
    return {"archived_previous": old, "output": a.output, "by_finish_reason": _counts(files.read_jsonl(spark, a.output, PREDICTION), "finish_reason")}


def oracle_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = generate.oracle_predictions(evaluate.select_rows(_rows(spark, a.input), files.ORDER, a.limit))
    old = files.write_jsonl(out, a.output, keep_old=True)
    return {"archived_previous": old, "output": a.output, "by_finish_reason": _counts(files.read_jsonl(spark, a.output, PREDICTION), "finish_reason")}


def evaluate_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One run, or two columns of the same rows compared."""
    rows = files.with_order(files.require_jsonl(spark, a.input, PREDICTION + f", `{a.field}` string" * (a.field != "prediction") + (f", `{a.baseline_field}` string" if a.baseline_field else "")))
    column = lambda c: rows if c == "prediction" else rows.drop("prediction").withColumnRenamed(c, "prediction")
    runs = {a.field: column(a.field)} | ({a.baseline_field: column(a.baseline_field)} if a.baseline_field else {})
    payload = report.report_payload(runs, files.ORDER, a.baseline_field)
    if a.output:
        files.write_text(a.output, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")
    return payload


def report_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    payload = report.report_payload(report.load_runs(spark, a.run), files.ORDER, a.baseline)
    report.write_report(payload, a.markdown, a.json, a.title)
    return {"markdown": a.markdown, "json": a.json, "runs": [r["label"] for r in payload["runs"]], "comparisons": len(payload["comparisons"])}


def pack_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Triage rows of two or more runs; the first ``label=path`` is the old run, the last the new one."""
    runs = report.load_runs(spark, a.run)
    labels = list(runs)
    scored = {label: evaluate.score_items(rows, keep=("id", files.ORDER)) for label, rows in runs.items()}
    records = _rows(spark, a.input).select("id", "subtype", "answer_type", "question", "gold", "program", "context", files.ORDER)
    pack = evaluate.failure_pack(records, scored, labels[0], labels[-1], files.ORDER).drop(files.ORDER).persist()
    files.write_csv(pack, a.csv, keep_old=True)
    if a.markdown:
        files.archive(a.markdown)
        files.write_text(a.markdown, report.render_pack(pack, labels[0], labels[-1]))
    return {"csv": a.csv, "rows": pack.count(), "priority_rows": pack.where("priority = 'yes'").count()}


def config_command(_: SparkSession | None, a: argparse.Namespace) -> dict:
    """Whether model calls could be made; values are never shown."""
    loaded = sorted(files.load_env(a.env_file)) if a.env_file else []
    missing = []
    if os.environ.get(generate.CALLS_ENV) != "1":
        missing.append(f"{generate.CALLS_ENV} must be 1 for intentional model calls")
    missing += [f"{k} is not set" for k in (generate.KEY_ENV, generate.URL_ENV) if not os.environ.get(k)]
    status = files.env_status([generate.CALLS_ENV, generate.KEY_ENV, generate.URL_ENV])
    return {"loaded_keys": loaded, "reasons": missing, "ready_for_model_calls": not missing, "status": status}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerloom", description="Prepare and evaluate question-answering data.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(run.__doc__ or name).splitlines()[0])
        p.set_defaults(call=run, code=0)
        for x in positional:
            p.add_argument(x)
        return p

    p = add("normalize", normalize_command, "input", "output")
    p.add_argument("--source-split", default="unknown")
    p.add_argument("--limit", type=int)
    p = add("split", split_command, "input", "output_dir")
    p.add_argument("--stratify-field", default="subtype")
    p.add_argument("--seed", type=int, default=13)
    for name, share in sampling.SPLIT_RATIOS.items():
        p.add_argument(f"--{name}", type=float, default=share)
    p = add("decontaminate", decontaminate_command, "candidates", "protected", "kept", "report")
    p.add_argument("--text-field", default="prompt")
    p.add_argument("--id-field", default="id")
    p.add_argument("--ngram", type=int, default=13)
    p.add_argument("--threshold", type=float, default=0.2)
    p = add("chat", chat_command, "input", "output")
    p.add_argument("--no-prefix", action="store_true")
    for kind in ("calculation", "reasoning", "program", "targeted", "source"):
        p = add(f"build-{kind}", build_command, "input", "output", "chat")
        p.set_defaults(kind=kind, exclude=[], no_think=False)
        p.add_argument("--total", type=int)
        p.add_argument("--seed", type=int)
        if kind in ("program", "targeted", "source"):
            p.add_argument("--exclude", action="append", default=[], help="rows whose ids are left out; repeatable")
            p.add_argument("--no-think", action="store_true")
    for kind in ("program", "source"):
        p = add(f"validate-{kind}", validate_command, "input")
        p.set_defaults(kind=kind)
        p.add_argument("--chat")
        p.add_argument("--field", default="assistant_program")
        p.add_argument("--min-match-rate", type=float, default=0.98)
        p.add_argument("--max-errors", type=int, default=0)
        p.add_argument("--report")
    p = add("predict", predict_command, "input", "output")
    p.add_argument("--provider", default="offline_first_number")
    p.add_argument("--model", default="offline-first-number")
    p.add_argument("--limit", type=int)
    p.add_argument("--exclude-id", action="append", default=[])
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--max-tokens", type=int, default=128)
    p.add_argument("--retries", type=int, default=4)
    for flag in ("include-prompts", "resume", "continue-on-error", "no-think"):
        p.add_argument(f"--{flag}", action="store_true")
    p = add("plan", plan_command, "input", "output")
    p.add_argument("--replies", help="JSON lines of id and reply instead of model calls")
    p.add_argument("--model", default="replies")
    p.add_argument("--limit", type=int)
    p.add_argument("--source", action="store_true")
    p.add_argument("--no-think", action="store_true")
    p = add("oracle", oracle_command, "input", "output")
    p.add_argument("--limit", type=int)
    p = add("evaluate", evaluate_command, "input")
    p.add_argument("--field", default="prediction")
    p.add_argument("--baseline-field")
    p.add_argument("--output")
    p = add("report", report_command, "markdown")
    p.add_argument("--run", action="append", required=True, help="label=path; repeatable")
    p.add_argument("--baseline")
    p.add_argument("--json")
    p.add_argument("--title", default="Evaluation report")
    p = add("pack", pack_command, "input", "csv")
    p.add_argument("--run", action="append", required=True, help="label=path; repeatable, old run first")
    p.add_argument("--markdown")
    p = add("check-config", config_command)
    p.add_argument("--env-file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; the exit code is 1 where a validation fails its thresholds."""
    a = parser().parse_args(argv)
    session = None if a.call is config_command else spark or build_session(os.environ.get("LEDGERLOOM_MASTER", "local[*]"))
    out = a.call(session, a)
    print(json.dumps(out, sort_keys=True, default=str))
    return a.code


if __name__ == "__main__":
    sys.exit(main())
