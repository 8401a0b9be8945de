"""Programs as columns: execution, the flat calculator, extraction from replies, tags and classes."""

from __future__ import annotations

import ast
import re
from decimal import Decimal, DecimalException, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import program as lang
from ledgerloom.functions.numbers import number_token_count
from ledgerloom.functions.text import text

RUN_TYPE = "answer string, trace string, ops array<string>, steps int, error string, supported boolean, outer array<string>"


def _run_one(p: str | None) -> tuple:
    try:
        r = lang.execute(p)
    except (lang.ProgramError, DecimalException, OverflowError) as e:
        return None, None, [], 0, str(e) or type(e).__name__, supported_sequence(p or ""), lang.operation_names(p)
    return r.answer, r.trace, [s.operation for s in r.steps], len(r.steps), None, supported_sequence(p), lang.operation_names(p)


def _run_batch(programs: pd.Series) -> pd.DataFrame:
    known = {p: _run_one(p) for p in programs.unique()}
    rows = [known[p] for p in programs]
    return pd.DataFrame(rows, columns=["answer", "trace", "ops", "steps", "error", "supported", "outer"])


def run_program(c: Column) -> Column:
    """Struct (answer, trace, ops, steps, error, supported, outer) of each program.

    A failing one has only ``error``, ``supported`` (top-level calls of known operations) and
    ``outer`` (the operations of the outermost calls).
    """
    return F.pandas_udf(_run_batch, RUN_TYPE)(c)


# Fixed value: operations of the flat calculator.
FLAT = frozenset({"add", "subtract", "multiply", "divide", "table_sum", "table_average", "table_max", "table_min"})
_INNERMOST = re.compile(r"([A-Za-z_]+)\(([^()]*)\)")


def flat_run(program: str | None) -> tuple[Decimal, str] | None:
    """(value, trace) by the weaker calculator: innermost calls in order of appearance, outer ones ignored."""
    steps: list[lang.Step] = []
    calls = _INNERMOST.findall(program or "")
    if not calls:
        return None
    for name, args in calls:
        name = name.lower()
        parts = [a.strip() for a in args.split(",") if a.strip()]
        if name not in FLAT or not parts or any(a[:1] == "(" for a in parts):
            return None
        frame = lang._Frame(name)
        try:
            for a in parts:
                value, shown = lang._operand(a, steps)
                frame.values.append(value)
                frame.shown.append(shown)
            lang._close(frame, steps)
        except (lang.ProgramError, DecimalException, OverflowError):
            return None
    return steps[-1].value, "; ".join(s.expression for s in steps)


def _calc_gold(gold: str | None) -> Decimal | None:
    try:
        return Decimal(re.sub(r"[,$%]", "", (gold or "").strip()))
    except DecimalException:
        return None


def value_matches_gold(value: Decimal, gold: str | None) -> bool:
    """Within 0.005, or 0.1 % of the larger one."""
    g = _calc_gold(gold)
    if g is None or not g.is_finite():
        return False
    with localcontext(lang.CONTEXT):
        return abs(value - g) <= max(Decimal("0.005"), Decimal("0.001") * max(abs(value), abs(g)))


def _flat_batch(programs: pd.Series, golds: pd.Series) -> pd.DataFrame:
    out = []
    for p, g in zip(programs, golds):
        r = flat_run(p)
        if r is None:
            out.append((None, None, False))
        else:
            try:
                shown = lang.format_decimal(r[0])
            except lang.ProgramError:
                shown = None
            out.append((shown, r[1], shown is not None and bool(_calc_gold(g)) and value_matches_gold(r[0], g)))
    return pd.DataFrame(out, columns=["result", "trace", "matches"])


def calculate(program: Column, gold: Column) -> Column:
    """Struct (result, trace, matches) by the flat calculator; a gold of zero or no number never matches."""
    return F.pandas_udf(_flat_batch, "result string, trace string, matches boolean")(program, gold)


def normalize_program(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(text(c), r"^[\s`]+|[\s`]+$", ""), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"\s*,\s*", ", ")
    return F.regexp_replace(F.regexp_replace(t, r"\(\s+", "("), r"\s+\)", ")")


# Fixed value: how a call of the language starts.
_CALL = re.compile(r"\b(" + "|".join(lang.OPERATIONS) + r")\s*\(", re.I)


def supported_sequence(program: str) -> bool:
    """Top-level calls of known operations, separated by commas."""
    depth, head, ok = 0, "", False
    for ch in program:
        if ch == "(":
            if depth == 0:
                if head.strip().lower() not in lang.OPERATIONS:
                    return False
                head = ""
            depth += 1
        elif ch == ")":
            depth -= 1
            ok = True
            if depth < 0:
                return False
        elif depth == 0:
            if ch == ",":
                if head.strip():
                    return False
                head = ""
            else:
                head += ch
    return ok and depth == 0 and not head.strip()


def extract_program(reply: str | None) -> str | None:
    """The first program in a model reply: in the text without fences, in fenced blocks, then line by line."""
    raw = (reply or "").strip()
    places = [re.sub(r"```(?:\w+)?", "\n", raw), *re.findall(r"```(?:\w+)?\s*(.*?)```", raw, re.S), *raw.splitlines()]
    for place in places:
        m = _CALL.search(place)
        if not m:
            continue
        rest = place[m.start() :]
        ends, depth = [], 0
        for i, ch in enumerate(rest):
            depth += (ch == "(") - (ch == ")")
            if depth < 0:
                break
            if ch == ")" and depth == 0:
                ends.append(i + 1)
        for end in reversed(ends):
            part = rest[:end].strip().strip("`").strip()
            if supported_sequence(part):
                flat = " ".join(part.split())
                flat = re.sub(r"\s*,\s*", ", ", flat)
                return re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", flat))
    return None


def _extract_batch(replies: pd.Series) -> pd.Series:
    known = {r: extract_program(r) for r in replies.unique()}
    return pd.Series([known[r] for r in replies], dtype=object)


def extract_program_column(c: Column) -> Column:
    """The program in each reply, null where there is none."""
    return F.pandas_udf(_extract_batch, "string")(c)


def operand_lists(c: Column) -> Column:
    """Struct (source_numbers, constants): distinct operands in order, references left out."""
    args = F.regexp_extract_all(text(c), F.lit(r"[(,]\s*([^(),]+?)\s*(?=[,)])"), 1)
    leaf = F.array_distinct(F.filter(args, lambda a: (a != "") & ~a.startswith("#")))
    return F.struct(
        F.filter(leaf, lambda a: ~a.startswith("const_")).alias("source_numbers"),
        F.filter(leaf, lambda a: a.startswith("const_")).alias("constants"),
    )


# Words by which questions are tagged.
CHANGE = (
    r"(?iU)\b(change|changed|increase|increased|decrease|decreased|growth|grew|decline|declined|from|to|compared|versus|vs\.?|"
    r"percent(?:age)? point)\b"
)
DIRECTION = (
    r"(?iU)\b(change|increase|decrease|decline|reduction|lower|higher|less|more|gain|loss|improvement|deterioration)\b"
)
AGGREGATION = r"(?iU)\b(average|mean|total|sum|combined|aggregate|maximum|minimum|max|min|range)\b"
SCALE_OR_UNIT = (
    r"(?iU)%|\b(percent|percentage|basis points?|bps|million|millions|billion|billions|thousand|thousands|share of|as a share|"
    r"proportion)\b"
)
NEGATIVE_OPERAND = r"(?iU)(^|[\s,(])-\d|const_m\d"


_BELOW = -(1 << 30)


def program_ops(c: Column) -> Column:
    """Operations of the outermost calls, in order, however deep the others are nested; none where brackets do not match."""
    marks = F.regexp_extract_all(text(c), F.lit(r"[A-Za-z_]*\s*\(|\)"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("ops"))

    def step(a: Column, mark: Column) -> Column:
        name = F.lower(F.regexp_extract(mark, "^[A-Za-z_]+", 0))
        outer = (a["depth"] == 0) & (name != "")
        return F.when(
            mark == ")",
            F.struct(F.when(a["depth"] <= 0, F.lit(_BELOW)).otherwise(a["depth"] - 1).alias("depth"), a["ops"].alias("ops")),
        ).otherwise(F.struct((a["depth"] + 1).alias("depth"), F.when(outer, F.concat(a["ops"], F.array(name))).otherwise(a["ops"]).alias("ops")))

    return F.aggregate(marks, start, step, lambda a: F.when(a["depth"] == 0, a["ops"]).otherwise(F.array().cast("array<string>")))


def target_tags(program: Column, question: Column, context: Column, kind: Column, table_rows: Column, ops: Column, steps: Column) -> Column:
    """Failure-mode tags of a program row, in a fixed order."""
    q, p, ctx = text(question), text(program), text(context)
    percent = F.lower(text(kind)) == "percent"
    has = lambda name: F.array_contains(ops, name)
    rows = F.coalesce(table_rows, F.lit(0))
    tag = lambda name, cond: F.when(cond, F.lit(name))
    return F.array_compact(
        F.array(
            tag("table_aggregation", F.exists(ops, lambda o: o.startswith("table_")) | (q.rlike(AGGREGATION) & ((rows >= 3) | ctx.contains("Table:")))),
            tag("sign_direction", has("subtract") & (p.rlike(NEGATIVE_OPERAND) | q.rlike(DIRECTION))),
            tag("unit_scale", percent | F.lower(p).contains("const_100") | F.concat_ws(" ", q, p).rlike(SCALE_OR_UNIT)),
            tag("percent_change_template", has("subtract") & has("divide") & (q.rlike(CHANGE) | percent)),
            tag("multi_step_program", steps >= 2),
            tag("source_number_selection", (rows >= 4) | (number_token_count(ctx) >= 30)),
        )
    )


def operation_class(ops: Column, tags: Column, question: Column, kind: Column) -> Column:
    """One label per program, by an ordered decision over operations and tags."""
    has = lambda name: F.array_contains(ops, name)
    tagged = lambda name: F.array_contains(tags, name)
    return (
        F.when(has("greater"), "comparison")
        .when(tagged("percent_change_template"), "percent_change")
        .when(tagged("table_aggregation"), "table_aggregation")
        .when(has("multiply") & (tagged("unit_scale") | F.lower(text(question)).contains("share")), "unit_scale")
        .when(has("multiply"), "product_or_share")
        .when(has("divide") & ~has("subtract"), "ratio")
        .when(has("subtract") & ~has("divide"), "difference")
        .when(F.size(ops) >= 2, "multi_step")
        .when(has("add"), "sum_or_lookup")
        .when(F.lower(text(kind)) == "percent", "percent")
        .otherwise("other")
    )


def literal_values(item: str | None) -> list[str]:
    """Values of an evidence item: of a dictionary or list literal its values, else the item itself."""
    t = (item or "").strip()
    if not t:
        return []
    try:
        parsed = ast.literal_eval(t)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return [t]
    values = parsed.values() if isinstance(parsed, dict) else parsed if isinstance(parsed, (list, tuple)) else [parsed]
    return [v for v in (str(x).strip() for x in values) if v]


# Fixed value: the hint of a row without evidence.
NO_EVIDENCE = "Use the relevant values from the provided context."


def _hint(items: list | None, most: int, size: int) -> str:
    found: list[str] = []
    for item in items if items is not None else []:
        found += literal_values(item)
        if len(found) >= most:
            break
    t = " ".join("; ".join(found[:most] or [NO_EVIDENCE]).split())
    return t if len(t) <= size else t[: size - 3].rstrip() + "..."


def evidence_hint(c: Column, most: int = 2, size: int = 420) -> Column:
    """The first ``most`` evidence values, joined and cut to ``size`` characters."""
    return F.pandas_udf(lambda s: s.map(lambda x: _hint(x, most, size)), "string")(c)
