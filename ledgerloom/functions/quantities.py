"""Quantities in free text: figure, scale, unit, and the units a report page states.

Plain Python over strings, for Arrow batches.  A quantity is a ``Decimal`` figure
with an optional scale (a power of ten) and an optional unit; each unit belongs to
a common unit with an exact factor.
"""

from __future__ import annotations

import re
from decimal import Decimal
from typing import NamedTuple

from ledgerloom.functions.questions import clean

# Spellings of scales.
SCALES = {
    "k": 3, "000": 3, "000s": 3, "thousand": 3, "thousands": 3,
    "m": 6, "mm": 6, "mn": 6, "mln": 6, "million": 6, "millions": 6,
    "b": 9, "bn": 9, "bln": 9, "billion": 9, "billions": 9,
    "tn": 12, "trn": 12, "trillion": 12, "trillions": 12,
}
# Spellings of units, their common unit and factor.
UNITS = {
    **dict.fromkeys(("$", "us$", "usd", "dollar", "dollars", "us dollars"), ("usd", "1")),
    **dict.fromkeys(("€", "eur", "euro", "euros"), ("eur", "1")),
    **dict.fromkeys(("£", "gbp", "pound", "pounds", "pounds sterling"), ("gbp", "1")),
    **dict.fromkeys(("%", "percent", "per cent", "pct", "percentage points"), ("percent", "1")),
    **dict.fromkeys(("bps", "bp", "basis points", "basis point"), ("percent", "0.01")),
    **dict.fromkeys(("as a fraction", "fraction"), ("percent", "100")),
    **dict.fromkeys(("kwh", "kilowatt hours", "kilowatt-hours", "kilowatthours"), ("mwh", "0.001")),
    **dict.fromkeys(("mwh", "megawatt hours", "megawatt-hours", "megawatthours"), ("mwh", "1")),
    **dict.fromkeys(("gwh", "gigawatt hours", "gigawatt-hours", "gigawatthours"), ("mwh", "1000")),
    **dict.fromkeys(("twh", "terawatt hours", "terawatt-hours", "terawatthours"), ("mwh", "1000000")),
    **dict.fromkeys(("kg", "kilogram", "kilograms", "kilogrammes"), ("tonne", "0.001")),
    **dict.fromkeys(("t", "tonne", "tonnes", "metric tons", "metric tonnes"), ("tonne", "1")),
    **dict.fromkeys(("kt", "kilotonne", "kilotonnes"), ("tonne", "1000")),
    **dict.fromkeys(("mt", "megatonne", "megatonnes"), ("tonne", "1000000")),
    **dict.fromkeys(("short ton", "short tons"), ("tonne", "0.90718474")),
    **dict.fromkeys(("long ton", "long tons"), ("tonne", "1.0160469088")),
    **dict.fromkeys(("lb", "lbs"), ("tonne", "0.00045359237")),
    **dict.fromkeys(("sq ft", "sqft", "sq. ft", "sq. ft.", "square foot", "square feet"), ("sqft", "1")),
    **dict.fromkeys(("sq m", "sqm", "m²", "m2", "square metre", "square metres", "square meters"), ("sqft", "10.763910416709722")),
    **dict.fromkeys(("share", "shares"), ("share", "1")),
    **dict.fromkeys(("x", "times"), ("multiple", "1")),
}
# Words that say that a figure has no scale.
PLAIN = ("in whole", "in actual", "(whole", "(actual", "whole", "actual")
MONEY = frozenset({"usd", "eur", "gbp"})
PHYSICAL = frozenset({"mwh", "tonne", "sqft", "share"})

NUMBER = r"(?:\d{1,3}(?:[,  ']\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"
_alt = lambda names: "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted(names, key=len, reverse=True))
_MONEY_MARK = r"us\$|usd|eur|gbp|[$€£]"
QUANTITY = (
    rf"(?P<pre>(?:[-+(]|{_MONEY_MARK}|\s)*)(?P<num>{NUMBER})(?P<close>\s*\))?"
    rf"(?P<post>(?:\s*(?:(?:{_alt(SCALES)})(?![a-z0-9])|of(?![a-z])|in\s+(?:whole|actual)\s+[a-z]+|"
    rf"\((?:whole|actual)\s+[a-z]+\)|(?:{_alt(n for n in UNITS if n[0].isalpha())})(?![a-z0-9])|%|m²))*)"
)
_QUANTITY = re.compile(QUANTITY)
_WHOLE = re.compile(rf"\s*{QUANTITY}\s*\)?\s*[.;]?\s*")
_SCALE_WORD = re.compile(rf"(?<![a-z0-9])(?:{_alt(SCALES)})(?![a-z0-9])")
_UNIT_WORD = re.compile(rf"{_MONEY_MARK}|%|m²|(?<![a-z0-9])(?:{_alt(n for n in UNITS if n[0].isalpha())})(?![a-z])")
_PLAIN = re.compile(r"\b(?:whole|actual)\s+([a-z]+)")


class Quantity(NamedTuple):
    figure: Decimal
    scale: int | None  # power of ten; None where the text names none
    unit: str | None  # common unit
    factor: Decimal  # of the unit in its common unit
    worded: bool  # the unit is more than a currency sign


def _parts(m: re.Match) -> Quantity:
    pre, post = m["pre"], m["post"]
    figure = Decimal(re.sub(r"[,  ']", "", m["num"]))
    if "-" in pre or ("(" in pre and m["close"]):
        figure = -figure
    scale, unit, factor, worded = None, None, Decimal(1), False
    plain = _PLAIN.search(post)
    if plain:
        scale, worded = 0, True
        unit = UNITS.get(plain[1], (None, "1"))[0]
        post = post[: plain.start()] + post[plain.end() :]
    s = _SCALE_WORD.search(post)
    if s:
        scale = SCALES[s[0]]
        post = post[: s.start()] + " " + post[s.end() :]
    for where, text in ((0, post), (1, pre)):
        u = _UNIT_WORD.search(text)
        if u and unit is None:
            unit, f = UNITS[re.sub(r"\s+", " ", u[0])]
            factor, worded = Decimal(f), worded or where == 0
    return Quantity(figure, scale, unit, factor, worded)


def parse_quantity(text: str | None) -> Quantity | None:
    """The quantity that ``text`` consists of, or None where it is anything else."""
    m = _WHOLE.fullmatch(clean(text).lower())
    return _parts(m) if m else None


def find_quantity(text: str) -> Quantity | None:
    """The first quantity in ``text`` (cleaned, lower case)."""
    m = _QUANTITY.search(text)
    return _parts(m) if m else None


class Stated(NamedTuple):
    """Scale and unit that a heading or sentence states; None where it states none."""

    scale: int | None
    unit: str | None
    factor: Decimal


NOTHING = Stated(None, None, Decimal(1))


# Money marks of headings such as €m and $000.
_GLUED = re.compile(r"(us\$|[$€£])\s*(000s?|k|mm|mn|m|bn|b)(?![a-z0-9])")


def stated(text: str) -> Stated:
    """Scale and unit named by a row heading, column heading or sentence (cleaned, lower case)."""
    text = _GLUED.sub(r"\1 \2", text)
    s = _SCALE_WORD.search(text)
    rest = text[: s.start()] + " " + text[s.end() :] if s else text
    u = _UNIT_WORD.search(rest)
    unit, factor = UNITS[re.sub(r"\s+", " ", u[0])] if u else (None, "1")
    return Stated(SCALES[s[0]] if s else None, unit, Decimal(factor))


_TABLE = re.compile(r"(?:^|\n)table:[ \t]*\n(.*?)(?:\n[ \t]*\n|\Z)", re.S)
_YEARS = re.compile(r"\b(?:19|20)\d\d\b")
_LABEL_UNIT = re.compile(r"\(([^()]*)\)\s*$|,\s*((?:in\s+)?(?:thousands?|millions?|billions?)(?:\s+of\s+\w+)?)\s*$")
# Words of sentences that speak of the table's units.
_UNIT_NOUNS = ("amounts", "figures", "schedule", "table", "values", "accounts", "currency", "presented", "expressed", "stated")
_UNIT_TALK = re.compile(r"\b(?:in|currency:?|stated)\b(.*)", re.S)


class Page(NamedTuple):
    """What a report page states about units: by row heading, in the table's head, in its sentences."""

    rows: dict[str, tuple[Stated, list[str]]]
    head: Stated
    text: Stated


def read_page(context: str | None) -> Page:
    """Units of a page with ``Pre-text``, ``Table`` and ``Post-text`` sections; all empty for null."""
    t = (context or "").replace("−", "-").lower()
    m = _TABLE.search(t)
    rows: dict[str, tuple[Stated, list[str]]] = {}
    head = NOTHING
    if m:
        lines = m[1].split("\n")
        head = stated(" ".join(_YEARS.sub(" ", lines[0]).replace("|", " ").split()))
        for line in lines[1:]:
            label, *cells = [c.strip() for c in line.split("|")]
            label = " ".join(label.split())
            u = _LABEL_UNIT.search(label)
            said = stated(u[1] or u[2] or "") if u else NOTHING
            name = label[: u.start()].strip(" ,") if u else label
            if said.unit is None:
                for c in cells:
                    mark = re.search(_MONEY_MARK, c)
                    if mark:
                        said = said._replace(unit=UNITS[mark[0]][0])
                        break
            rows.setdefault(name, (said, cells))
        t = t[: m.start()] + "\n" + t[m.end() :]
    scale = unit = None
    for sentence in t.replace("\n", ".").split("."):
        if not any(n in sentence for n in _UNIT_NOUNS):
            continue
        said = stated(sentence) if "amounts" in sentence else NOTHING
        if said.scale is None and said.unit is None:
            talk = _UNIT_TALK.search(sentence)
            said = stated(talk[1]) if talk else NOTHING
        scale = said.scale if scale is None else scale
        unit = said.unit if unit is None and said.unit in MONEY else unit
    return Page(rows, head, Stated(scale, unit, Decimal(1)))


#: A unit request in a question: ``in thousands of dollars``, ``(in millions)``, ``expressed in euros``.
_UNIT_REQUEST = re.compile(
    r"\bin\s+(?:(?:thousands?|millions?|billions?)(?:\s+of\s+(?:us\s+)?[a-z]+)?|(?:us\s+)?dollars|euros|pounds|"
    r"(?:whole|actual)\s+[a-z]+|square\s+(?:feet|met(?:re|er)s)|tonnes|[kmgt]wh)\b"
)
