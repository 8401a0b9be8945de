"""Markdown and JSON reports over small summaries."""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.evaluate import compare_runs, score_items, summarize
from ledgerloom.sources.files import archive, read_jsonl, with_order, write_text

#: Failure-pack rows that the Markdown version shows.
SHOWN = 30


def run_spec(text: str) -> tuple[str, str]:
    """(label, path) of ``label=path``."""
    label, eq, path = text.partition("=")
    if not eq or not label.strip() or not path.strip():
        raise ValueError(f"label=path expected, not {text!r}")
    return label.strip(), path.strip()


def load_runs(spark: SparkSession, specs: list[str]) -> dict[str, DataFrame]:
    """Prediction rows of each ``label=path``, with their order as ``_ord``; a label may be used once."""
    runs: dict[str, DataFrame] = {}
    for label, path in map(run_spec, specs):
        if label in runs:
            raise ValueError(f"label used twice: {label}")
        runs[label] = with_order(read_jsonl(spark, path))
    return runs


def report_payload(runs: dict[str, DataFrame], order: str, baseline: str | None = None) -> dict:
    """Summaries of each run and its comparison with the baseline; runs map labels to prediction rows."""
    scored = {label: score_items(rows, keep=("id", order)) for label, rows in runs.items()}
    out: dict = {"runs": [], "comparisons": []}
    for label, items in scored.items():
        rows = [r.asDict() for r in summarize(items).collect()]
        out["runs"].append({"label": label, "summary": next((r for r in rows if r["overall"] == 1), None), "by_subtype": sorted((r for r in rows if r["overall"] == 0), key=lambda r: r["subtype"])})
    if baseline is not None:
        if baseline not in scored:
            raise ValueError(f"no run {baseline}")
        for label, items in scored.items():
            if label != baseline:
                out["comparisons"].append({"baseline": baseline, "candidate": label, **compare_runs(scored[baseline], items, order).first().asDict()})
    return out


def _cells(values) -> str:
    return "| " + " | ".join(str(v) for v in values) + " |"


def render(payload: dict, title: str = "Evaluation report") -> str:
    """Markdown: headline table, exact match by subtype, paired comparisons."""
    pct = lambda x: f"{100 * x:.1f}%"
    ci = lambda a, b, sign="": f"[{100 * a:{sign}.1f}, {100 * b:{sign}.1f}]"
    lines = [f"# {title}", "", "## Runs", "", _cells(["Run", "N", "Exact match", "95% interval", "Format violations", "Unsupported figures"])]
    lines.append("| --- | ---: | ---: | --- | ---: | ---: |")
    for run in payload["runs"]:
        s = run["summary"]
        if s:
            lines.append(_cells([run["label"], s["n"], pct(s["exact_match"]), ci(s["ci_low"], s["ci_high"]), pct(s["format_violation_rate"]), pct(s["hallucinated_figure_rate"])]))
    names = sorted({r["subtype"] for run in payload["runs"] for r in run["by_subtype"]})
    if names:
        lines += ["", "## By subtype", "", _cells(["Run", *names]), _cells(["---"] + ["---:"] * len(names))]
        for run in payload["runs"]:
            by = {r["subtype"]: r for r in run["by_subtype"]}
            lines.append(_cells([run["label"], *(f"{pct(by[n]['exact_match'])} (n={by[n]['n']})" if n in by else "NA" for n in names)]))
    if payload["comparisons"]:
        lines += ["", "## Paired comparisons", "", _cells(["Baseline", "Candidate", "N", "Delta", "95% interval", "p"]), "| --- | --- | ---: | ---: | --- | ---: |"]
        for c in payload["comparisons"]:
            lines.append(_cells([c["baseline"], c["candidate"], c["n_paired"], f"{100 * c['paired_delta']:+.1f}", ci(c["delta_low"], c["delta_high"], "+"), f"{c['p_value']:.4g}"]))
    return "\n".join(lines) + "\n"


def write_report(payload: dict, markdown: str, as_json: str | None = None, title: str = "Evaluation report") -> None:
    """Both files, what was there archived first."""
    for path, text in ((markdown, render(payload, title)), (as_json, json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False))):
        if path:
            archive(path)
            write_text(path, text if text.endswith("\n") else text + "\n")


def render_pack(pack: DataFrame, old: str, new: str, shown: int = SHOWN) -> str:
    """Markdown of a failure pack: counts of transitions and the first rows."""
    counts = {r["transition"]: r["count"] for r in pack.groupBy("transition").count().collect()}
    rows = pack.select("priority_rank", "id", "transition", "suggested_label", "gold", f"{old}_extracted", f"{new}_extracted").limit(shown).collect()
    clean = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = ["# Failure pack", "", *(f"- {k}: {n}" for k, n in sorted(counts.items())), ""]
    lines += [_cells(["Rank", "Id", "Transition", "Label", "Gold", old, new]), _cells(["---"] * 7)]
    return "\n".join(lines + [_cells(map(clean, r)) for r in rows]) + "\n"
