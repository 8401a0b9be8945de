"""One measured quantity in many units: every stated value in a common unit.

A value may name its unit and scale, or leave either to the question, to the asked
row of the page's table, to the head of the table or to the page's sentences.  Every
unit and scale that this evidence allows is a reading of the value.  Columns that
measure the same thing give identities: the gold answer equals its program over the
cells of the page, whose own scale is open in the same way, and the answers of a
prediction equal its gold.  The combination of readings with the smallest absolute log
residual is chosen; the residual is cut off at ``AGREES``, so a value that is simply
wrong, and agrees with its identity in no reading, pulls no reading towards it.  Among
combinations that fit equally well the one of the nearest evidence wins (the value's own
words, the question, the row, the head, the sentences), and the solution is flagged as
not unique if another one with another value fits as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import MAX_EMAX, MAX_PREC, MIN_EMIN, ROUND_HALF_UP, Context, Decimal
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import quantities as qty
from ledgerloom.functions.labels import issuer_code
from ledgerloom.functions.program import ProgramError, execute
from ledgerloom.functions.questions import clean, kind_of_text, words
from ledgerloom.functions.replies import is_abstention, language, stated_result
from ledgerloom.functions.strings import edits
from ledgerloom.session import small

#: Residual (in powers of ten) up to which a reading agrees with an identity.
AGREES = 0.02
_LEAST, _MOST = -(2**63), 2**63 - 1
_HUNDRED = Decimal(100)
#: Contexts of logarithms, and of products of any length.
_LOGS, _WIDE = Context(prec=17), Context(prec=MAX_PREC, Emax=MAX_EMAX, Emin=MIN_EMIN)


class Reading(NamedTuple):
    """One unit and scale that a value may have, and the value in the common unit then."""

    unit: str
    value: Decimal
    scale: int
    level: int  # 0 own words, 1 question, 2 row, 3 head of the table, 4 sentences, 5 nothing


class Solved(NamedTuple):
    unit: str
    amount: int | None  # 1000 times the value in the common unit; None where 64 bits cannot hold it
    scale: int
    level: int
    residual: float | None  # of the identity, in powers of ten
    unique: bool
    nearest: bool  # the nearest evidence was taken
    exact: str | None  # the amount in full, where 64 bits cannot hold it


class LazyPage:
    """A page that is read when its units are first asked for."""

    __slots__ = ("context", "page")

    def __init__(self, context: str | None) -> None:
        self.context, self.page = context, None

    def __call__(self) -> qty.Page:
        if self.page is None:
            self.page = qty.read_page(self.context)
        return self.page


def asked_row(question: str, page: qty.Page) -> tuple[qty.Stated, list[str]] | None:
    """The table row that the question names: exact words first, then words within one or two edits."""
    q = f" {question} "
    best = None
    for name, row in page.rows.items():
        if name and f" {name} " in q.replace(",", " ").replace("?", " ") and (best is None or len(name) > best[0]):
            best = (len(name), row)
    if best:
        return best[1]
    tokens = words(question)
    scored = []
    for name, row in page.rows.items():
        want = name.split()
        if not want:
            continue
        near = sum(any(w == t or (len(w) > 3 and edits(t, w, 2) <= 2) for t in tokens) for w in want)
        scored.append((near / len(want), len(want), row))
    scored.sort(key=lambda s: (-s[0], -s[1]))
    return scored[0][2] if scored and scored[0][0] >= 0.5 else None


def _thousandfold(value: Decimal) -> Decimal:
    """1000 times ``value`` as a whole number, however large."""
    return value.scaleb(3, _WIDE).to_integral_value(ROUND_HALF_UP, _WIDE)


def _fits(value: Decimal) -> bool:
    size = value.adjusted()
    return size < 15 or size < 20 and _LEAST <= _thousandfold(value) <= _MOST


def _times(a: Decimal, b: Decimal) -> Decimal:
    return _WIDE.multiply(a, b)


def _log(value: Decimal) -> float:
    return math.log10(abs(value)) if -300 < value.adjusted() < 300 else float(abs(value).log10(_LOGS))


def residual(value: Decimal, identity: Decimal) -> float:
    """Powers of ten between a value and what an identity implies; endless where only one of them is 0."""
    if not value or not identity:
        return 0.0 if value == identity else math.inf
    return abs(_log(value) - _log(identity))


def readings(
    stated: str | None, question: str | None, page: LazyPage, currency: str | None = None
) -> tuple[list[Reading], list[Reading]]:
    """(readings, doubts) of a stated value, nearest evidence first; none where it states no quantity.

    ``doubts`` are readings that the rules of the data exclude (a figure without a percent
    unit that answers a question for a percentage is a fraction of one): never taken, but
    where they fit an identity better, the solution is not unique.  ``currency`` is the
    issuer's, used where nothing on the page names one.
    """
    said = qty.parse_quantity(stated)
    if said is None:
        return [], []
    q = clean(question).lower()
    kind = kind_of_text(question)
    if said.unit == "multiple" or (kind == "ratio" and said.unit is None) or kind == "compare":
        return [], []
    if said.unit == "percent":
        return [Reading("percent", _times(said.figure, said.factor), 0, 0)], []
    if kind == "percent" and said.unit is None:
        return [Reading("percent", _times(said.figure, _HUNDRED), 0, 1)], [Reading("percent", said.figure, 0, 5)]
    own = qty.Stated(said.scale, said.unit, said.factor)
    if own.unit in qty.PHYSICAL and own.scale is None:
        plain = _times(said.figure, own.factor)
        return [Reading(own.unit, plain, 0, 0)], [Reading(own.unit, plain.scaleb(s, _WIDE), s, 5) for s in (3, 6)]
    read = page()
    row = asked_row(q, read)
    of_row = row[0] if row else qty.NOTHING
    asked = qty.stated(m[0]) if (m := qty._UNIT_REQUEST.search(q)) else qty.NOTHING
    evidence = [own, asked, of_row, read.head, read.text]
    named = [(e.unit, e.factor) for e in evidence if e.unit] or [(currency, Decimal(1))]
    unit = named[0][0]
    if unit is None or unit == "percent":
        return [], []
    physical = unit in qty.PHYSICAL
    if own.scale is not None:
        scales = [(0, own.scale)]
    else:
        # heads and sentences speak of money
        scales = [(level, e.scale) for level, e in enumerate(evidence) if e.scale is not None and not (physical and level >= 3)]
        if physical and of_row.unit and of_row.scale is None:
            scales = sorted([*scales, (2, 0)])
        if not physical and scales:
            scales.append((5, 0))  # written out in full
    factors = [own.factor] if own.unit else list(dict.fromkeys(f for u, f in named if u == unit))
    out: dict[Decimal, Reading] = {}
    for factor in factors:
        for level, scale in scales or [(5, 0)]:
            value = _times(said.figure, factor).scaleb(scale, _WIDE)
            out.setdefault(value, Reading(unit, value, scale, level))
    return list(out.values()), []


def _misfit(reading: Reading, implied: list[Reading]) -> tuple[float, int, float | None]:
    """(residual cut off at ``AGREES``, place of the implied value it is from, residual); the cut-off without identity."""
    found = [(residual(reading.value, x.value), j) for j, x in enumerate(implied) if x.unit == reading.unit]
    return min(((min(round(d, 3), AGREES), j, d) for d, j in found), default=(AGREES, 0, None))


def choose(found: list[Reading], implied: list[Reading], doubts: list[Reading] = ()) -> Solved | None:
    """The reading of the combination (reading, implied value) with the smallest log residual, cut off at ``AGREES``.

    ``found`` and ``implied`` are in order of nearness, which decides between combinations
    that fit equally well.  A reading that 64 bits cannot hold is taken only where all are such.
    """
    if not found:
        return None
    scored = [(not _fits(r.value), *_misfit(r, implied), i) for i, r in enumerate(found)]
    over, loss, _, raw, place = min(scored, key=lambda s: (s[0], s[1], s[4], s[2]))
    r = found[place]
    rivals = [s[1] for s in scored if s[4] != place and not s[0]]
    doubtful = [_misfit(d, implied)[0] for d in doubts]
    # where nothing agrees every other reading is as good, but a doubt has to agree
    unique = all(x > loss for x in rivals + doubtful) if loss < AGREES else not rivals and all(x >= AGREES for x in doubtful)
    amount = _thousandfold(r.value)
    shown = None if raw is None or math.isinf(raw) else raw
    return Solved(r.unit, None if over else int(amount), r.scale, r.level, shown, unique, place == 0, f"{amount:f}" if over else None)


def solve(
    stated: str | None,
    question: str | None,
    page: LazyPage,
    implied: list[Reading] = (),
    currency: str | None = None,
) -> Solved | None:
    """The value of ``stated`` in its common unit, or None where it states no quantity.

    ``implied`` are the values that another column implies, each with the unit and scale
    under which it does.
    """
    found, doubts = readings(stated, question, page, currency)
    return choose(found, list(implied), doubts)


def program_values(program: str | None, question: str | None, page: LazyPage, currency: str | None) -> list[Reading]:
    """The values that a program over cells of the asked row implies, one per scale that the cells may have."""
    if not program:
        return []
    try:
        run = execute(program)
    except (ProgramError, ArithmeticError):
        return []
    if run.value is None or not run.value.is_finite():
        return []
    kind = kind_of_text(question)
    if kind == "percent":
        return [Reading("percent", _times(run.value, _HUNDRED), 0, 2)]
    if kind in ("ratio", "compare"):
        return []
    read = page()
    row = asked_row(clean(question).lower(), read)
    of_row = row[0] if row else qty.NOTHING
    unit = of_row.unit or read.head.unit or read.text.unit or currency
    if unit is None:
        return []
    if unit in qty.PHYSICAL:
        scale = of_row.scale or 0
        return [Reading(unit, _times(run.value, of_row.factor).scaleb(scale, _WIDE), scale, 2)]
    scales = {e.scale: level for level, e in ((4, read.text), (3, read.head), (2, of_row)) if e.scale is not None} or {0: 5}
    return sorted((Reading(unit, run.value.scaleb(s, _WIDE), s, level) for s, level in scales.items()), key=lambda r: r.level)


_OUT = (
    "rec_no long, field string, unit string, amount long, scale int, level int, residual double, unique boolean, "
    "nearest boolean, exact string"
)
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def _golds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for rec, gold, question, context, program, currency in zip(
            pdf["rec_no"], pdf["gold"], pdf["question"], pdf["context"], pdf["program"], pdf["currency"]
        ):
            if gold is None or not any(c.isdigit() for c in gold):
                continue
            page = LazyPage(context)
            implied = program_values(program, question, page, currency)
            got = solve(gold, question, page, implied, currency)
            if got is not None:
                out.append((rec, "gold", *got))
        yield pd.DataFrame(out, columns=_COLUMNS)


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for rec, gold, tuned, base, question, context, currency in zip(
            pdf["rec_no"], pdf["gold"], pdf["tuned_answer"], pdf["base_answer"], pdf["question"], pdf["context"], pdf["currency"]
        ):
            if is_abstention(gold):
                continue
            page = implied = None
            for field, text in (("tuned_answer", tuned), ("base_answer", base)):
                if text is None or not any(c.isdigit() for c in text):
                    continue
                result = stated_result(text)
                if result is None or qty.parse_quantity(result) is None or language(text) not in (None, "en"):
                    continue
                page = page or LazyPage(context)
                if implied is None:
                    known = solve(gold, question, page, [], currency)
                    implied = [Reading(known.unit, Decimal(known.exact or known.amount).scaleb(-3, _WIDE), known.scale, known.level)] if known else []
                got = solve(result, question, page, implied, currency)
                if got is not None:
                    out.append((rec, field, *got))
        yield pd.DataFrame(out, columns=_COLUMNS)


# Common units of the home currencies.
_HOME = {"USD": "usd", "EUR": "eur", "GBP": "gbp"}


def _with_currency(rows: DataFrame, path, issuers: DataFrame | None) -> DataFrame:
    if issuers is None:
        return rows.withColumn("currency", F.lit(None).cast("string"))
    home = F.create_map(*[F.lit(x) for p in _HOME.items() for x in p])
    known = (
        issuers.where("issuer_code is not null")
        .groupBy(F.upper(F.trim("issuer_code")).alias("issuer"))
        .agg(F.min(F.try_element_at(home, F.upper(F.trim("home_currency")))).alias("currency"))
    )
    return rows.withColumn("issuer", issuer_code(path)).join(small(known), "issuer", "left").drop("issuer")


def gold_quantities(records: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """(rec_no, field, unit, amount, scale, level, residual, unique, nearest, exact) of each ``gold`` that states a quantity.

    ``amount`` is 1000 times the value; where 64 bits hold it in no reading it is null and
    ``exact`` has its digits.  Null and blank golds, ratios, multiples, yes/no and abstentions give no row; a null
    question or context leaves only the value's own words.  Repeated rows count under
    their own row_id.
    """
    rows = records.select(
        F.col("row_id").alias("rec_no"), "gold", "question", "context", "program", F.coalesce("metadata.filename", "id").alias("path")
    ).where(F.col("gold").rlike("[0-9]"))
    rows = _with_currency(rows, F.col("path"), issuers)
    return rows.select("rec_no", "gold", "question", "context", "program", "currency").mapInPandas(_golds, _OUT)


def answer_quantities(predictions: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """The same for ``tuned_answer`` and ``base_answer`` of predictions, their gold serving as the identity.

    Replies that break off, decline, repeat the question or are in another language than
    English state no result here; neither do answers where the gold is an abstention.
    """
    rows = predictions.select(
        F.col("pred_no").alias("rec_no"), "gold", "tuned_answer", "base_answer", "question", "context", F.col("id").alias("path")
    )
    rows = rows.where(F.col("tuned_answer").rlike("[0-9]") | F.col("base_answer").rlike("[0-9]"))
    rows = _with_currency(rows, F.col("path"), issuers)
    names = ["rec_no", "gold", "tuned_answer", "base_answer", "question", "context", "currency"]
    return rows.select(*names).mapInPandas(_answers, _OUT)
