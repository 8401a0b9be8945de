"""The arithmetic program language: a scanner and a stack machine with exact decimals.

A program is a list of calls ``op(arg, ...)``; an argument is a call, ``#k`` (the
result of the k-th finished call, counted in the order in which calls close),
``const_n`` / ``const_mn`` (minus n), a figure or a percentage.  Scanning yields a
flat instruction list; the machine keeps one frame per open call.  Arithmetic is
decimal with 28 significant digits; only formatting rounds half up.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation, localcontext
from typing import NamedTuple

#: Arithmetic context of all programs.
CONTEXT = Context(prec=28)
# The operations, their operand counts (None: any, at least one for averages and extremes).
OPERATIONS = {
    "add": None,
    "subtract": 2,
    "multiply": None,
    "divide": 2,
    "exp": 2,
    "greater": 2,
    "table_sum": None,
    "table_average": None,
    "table_max": None,
    "table_min": None,
}
# How each operation is written in a trace.
_INFIX = {"add": " + ", "subtract": " - ", "multiply": " * ", "divide": " / ", "exp": " ^ ", "greater": " > "}
_NAMED = {"table_sum": "sum", "table_average": "average", "table_max": "max", "table_min": "min"}

_TOKEN = re.compile(r"\s*(?:(?P<open>[A-Za-z_ ]*[A-Za-z_])?\s*\(|(?P<close>\))|(?P<comma>,)|(?P<text>[^(),]+))")


class ProgramError(ValueError):
    """A program that cannot be scanned or run; the text names the reason."""


class Step(NamedTuple):
    operation: str
    operands: tuple[str, ...]
    value: Decimal | None  # None for yes/no results
    answer: str
    expression: str


class Run(NamedTuple):
    answer: str
    value: Decimal | None
    trace: str
    steps: tuple[Step, ...]


def format_decimal(value: Decimal, places: int = 6) -> str:
    """Half-up rounding to ``places``, trailing zeros dropped, never ``-0``."""
    try:
        rounded = value.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)
    except InvalidOperation as e:
        raise ProgramError("result out of range") from e
    text = f"{rounded:f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def parse_number(text: str) -> Decimal:
    """A figure with optional thousands commas, ``$``, ``%`` sign (ignored) or accounting brackets."""
    t = text.strip().replace(",", "").replace("$", "")
    if len(t) > 1 and t[0] == "(" and t[-1] == ")":
        t = "-" + t[1:-1]
    try:
        return Decimal(t.removesuffix("%"))
    except InvalidOperation as e:
        raise ProgramError(f"operand is no number: {text}") from e


class _Frame:
    __slots__ = ("name", "values", "shown", "pending")

    def __init__(self, name: str) -> None:
        self.name, self.values, self.shown, self.pending = name, [], [], None


def _apply(name: str, v: list[Decimal]) -> Decimal | str:
    want = OPERATIONS[name]
    if want is not None and len(v) != want:
        raise ProgramError(f"{name} takes {want} operands, not {len(v)}")
    if not v and name not in ("add", "multiply", "table_sum"):
        raise ProgramError(f"{name} has no operands")
    try:
        with localcontext(CONTEXT):
            match name:
                case "add" | "table_sum":
                    return sum(v, Decimal(0))
                case "table_average":
                    return sum(v, Decimal(0)) / len(v)
                case "subtract":
                    return v[0] - v[1]
                case "divide":
                    return v[0] / v[1]
                case "multiply":
                    out = Decimal(1)
                    for x in v:
                        out *= x
                    return out
                case "greater":
                    return "yes" if v[0] > v[1] else "no"
                case "table_max":
                    return max(v)
                case "table_min":
                    return min(v)
                case _:
                    whole = v[1] == v[1].to_integral_value()
                    return v[0] ** int(v[1]) if whole else Decimal(str(float(v[0]) ** float(v[1])))
    except (ArithmeticError, ValueError, TypeError) as e:
        raise ProgramError(f"{name} failed") from e


def _bracketed(text: str) -> str:
    return f"({text})" if text.startswith("-") else text


def _close(frame: _Frame, steps: list[Step]) -> tuple[Decimal, str]:
    if frame.name not in OPERATIONS:
        raise ProgramError(f"unknown operation: {frame.name}")
    result = _apply(frame.name, frame.values)
    answer = result if isinstance(result, str) else format_decimal(result)
    shown = [_bracketed(s) for s in frame.shown]
    if frame.name in _INFIX:
        text = _INFIX[frame.name].join(shown)
    else:
        text = f"{_NAMED[frame.name]}({', '.join(shown)})"
    value = None if isinstance(result, str) else result
    steps.append(Step(frame.name, tuple(frame.shown), value, answer, f"{text} = {answer}"))
    if value is None:
        return Decimal(1 if answer == "yes" else 0), answer
    return value, answer


def _operand(text: str, steps: list[Step]) -> tuple[Decimal, str]:
    if text.startswith("#"):
        try:
            k = int(text[1:])
        except ValueError as e:
            raise ProgramError(f"bad reference: {text}") from e
        if not 0 <= k < len(steps):
            raise ProgramError(f"reference out of range: {text}")
        if steps[k].value is None:
            raise ProgramError(f"reference to yes or no: {text}")
        return steps[k].value, steps[k].answer
    if text.startswith("const_"):
        rest = text[6:]
        value = parse_number("-" + rest[1:] if rest.startswith("m") else rest)
        return value, format_decimal(value)
    if text.endswith("%"):
        with localcontext(CONTEXT):
            return parse_number(text[:-1]) / 100, text
    return parse_number(text), text


def execute(program: str | None) -> Run:
    """Run a program; raises :class:`ProgramError` for anything that is not one."""
    text = (program or "").strip()
    frames: list[_Frame] = []
    steps: list[Step] = []
    at, after_call, top = 0, False, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ProgramError("program cannot be read")
            break
        at = m.end()
        frame = frames[-1] if frames else None
        if m["close"]:
            if frame is None:
                raise ProgramError("unbalanced parentheses")
            if frame.name == "(":  # an accounting bracket around one figure
                frames.pop()
                if not frames or frame.pending is None:
                    raise ProgramError("operand is no number: ()")
                frames[-1].pending = f"({frame.pending})"
                continue
            _settle(frame, steps, after_call)
            frames.pop()
            value, shown = _close(frame, steps)
            after_call = True
            if frames:
                frames[-1].values.append(value)
                frames[-1].shown.append(shown)
        elif m["comma"]:
            if frame is not None and frame.name != "(":
                _settle(frame, steps, after_call)
            after_call = False
        elif m["text"]:
            word = m["text"].strip()
            if not word:
                continue
            if frame is None or after_call or frame.pending is not None:
                raise ProgramError(f"call expected: {word}")
            frame.pending = word
        else:
            name = m["open"].strip().lower() if m["open"] else "("
            if after_call or (frame is not None and frame.pending is not None) or (name == "(" and frame is None):
                raise ProgramError("call expected")
            frames.append(_Frame(name))
            top += len(frames) == 1
    if frames:
        raise ProgramError("unbalanced parentheses")
    if not steps:
        raise ProgramError("program is empty")
    return Run(steps[-1].answer, steps[-1].value, "; ".join(s.expression for s in steps), tuple(steps))


def _settle(frame: _Frame, steps: list[Step], after_call: bool) -> None:
    if frame.pending is not None:
        value, shown = _operand(frame.pending, steps)
        frame.values.append(value)
        frame.shown.append(shown)
        frame.pending = None


def operation_names(program: str | None) -> list[str]:
    """Operations of the outermost calls, in order; empty for an unreadable program."""
    out, depth, at, text = [], 0, 0, program or ""
    for m in re.finditer(r"([A-Za-z_]+)\s*\(|[()]", text):
        if m[0] == ")":
            depth -= 1
            if depth < 0:
                return []
            continue
        if depth == 0 and m[1]:
            out.append(m[1].lower())
        depth += 1
    return out if depth == 0 else []


def operands(program: str | None) -> tuple[list[str], list[str]]:
    """(source figures, constants) of a program, each once, in order; references are skipped."""
    figures: dict[str, None] = {}
    constants: dict[str, None] = {}
    for m in re.finditer(r"[(,]\s*([^(),]+?)\s*(?=[,)])", program or ""):
        arg = m[1]
        if arg.startswith("#"):
            continue
        (constants if arg.startswith("const_") else figures).setdefault(arg)
    return list(figures), list(constants)
