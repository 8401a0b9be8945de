"""Numbers in free text and their comparison, as Column expressions on exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import contains_abstention, let, normalize_answer, strip, text

# Fixed value: the number grammar (currency, sign, figure, scale, percent), with no boundary after it.
NUMBER = (
    r"(?iU)(?<![A-Za-z0-9])([$€£])?\s*([-+])?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)\s*"
    r"(thousand|million|billion|trillion|mn|mm|bn|m|b|k)?\s*"
    r"(%|percent|percentage\s+points?|points?|basis\s+points?|bps)?"
)
# Scale words.
SCALES = {
    "k": "1000", "thousand": "1000", "m": "1000000", "mn": "1000000", "mm": "1000000", "million": "1000000",
    "b": "1000000000", "bn": "1000000000", "billion": "1000000000", "trillion": "1000000000000",
}
_D = "decimal(34,10)"
_PARSED = f"array<struct<surface: string, value: {_D}, raw: {_D}, scaled: boolean, is_percent: boolean>>"


def parse_decimal(c: Column, kind: str = "decimal(38,10)") -> Column:
    """A decimal from a text with optional commas, ``$`` and ``%``; null for anything else."""
    return F.regexp_replace(strip(text(c)), "[,$%]", "").try_cast(kind)


def extract_numbers(c: Column) -> Column:
    """Array of (surface, value, raw, scaled, is_percent) of all numbers in a text, in order."""
    scales = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v).cast("decimal(13,0)"))])

    def one(s: Column) -> Column:
        raw = F.regexp_replace(F.regexp_extract(s, NUMBER, 3), ",", "").try_cast("decimal(28,10)")
        raw = F.when(F.regexp_extract(s, NUMBER, 2) == "-", -raw).otherwise(raw)
        word = F.lower(F.regexp_extract(s, NUMBER, 4))
        scale = F.try_element_at(scales, word)
        value = F.when(word == "", raw.cast(_D)).otherwise((raw.cast("decimal(24,6)") * scale).try_cast(_D))
        return F.struct(
            strip(s).alias("surface"),
            value.alias("value"),
            raw.cast(_D).alias("raw"),
            (word != "").alias("scaled"),
            F.lower(F.regexp_extract(s, NUMBER, 5)).isin("%", "percent").alias("is_percent"),
        )

    found = F.transform(F.regexp_extract_all(text(c), F.lit(NUMBER), 0), one)
    return F.filter(found, lambda n: n["raw"].isNotNull()).cast(_PARSED)


def variants(n: Column) -> Column:
    """Readings of a number: its value, its figure without the scale, both as a percentage."""
    hundredth = lambda x: (x.cast("decimal(28,8)") * F.lit("0.01").cast("decimal(3,2)")).cast(_D)
    none = F.array().cast(f"array<{_D}>")
    return F.array_distinct(
        F.concat(
            F.array(n["value"]),
            F.when(n["scaled"], F.array(n["raw"])).otherwise(none),
            F.when(n["is_percent"], F.array(hundredth(n["value"]), hundredth(n["raw"]))).otherwise(none),
        )
    )


def close(a: Column, b: Column, factor: str = "1") -> Column:
    """Equal within rounding: 0.1 % of the larger one, at least 0.005 (0.0005 where both are under 1)."""
    x = a if factor == "1" else (a * F.lit(factor).cast("decimal(20,6)")).cast(_D)
    larger = F.greatest(F.abs(x), F.abs(b))
    floor = F.when(larger < 1, F.lit("0.0005").cast("decimal(5,4)")).otherwise(F.lit("0.005").cast("decimal(5,4)"))
    relative = (larger.cast("decimal(30,7)") * F.lit("0.001").cast("decimal(4,3)")).cast(_D)
    return F.abs(x - b) <= F.greatest(floor.cast(_D), relative)


def numbers_match(left: Column, right: Column, factors: tuple[str, ...] = ("1",)) -> Column:
    """Any reading of one number is close to any reading of another, times any of the factors."""
    pair = lambda x, y: F.reduce(F.array(*[close(x, y, f) for f in factors]), F.lit(False), lambda a, b: a | b)
    test = (lambda x, y: close(x, y)) if factors == ("1",) else pair
    return let(variants(right), lambda ys: F.exists(variants(left), lambda x: F.exists(ys, lambda y: test(x, y))))


def exact_match(prediction: Column, gold: Column, said: Column | None = None, want: Column | None = None) -> Column:
    """Struct (is_match, reason): numbers first, then abstention, then normalised text.

    ``said`` and ``want`` are the numbers of both where they are at hand already.
    """
    said = extract_numbers(prediction) if said is None else said
    want = extract_numbers(gold) if want is None else want
    numeric = let(want, lambda w: F.exists(said, lambda p: F.exists(w, lambda g: numbers_match(p, g))))
    same = normalize_answer(prediction) == normalize_answer(gold)
    hit = (
        F.when(F.size(want) > 0, numeric)
        .when(contains_abstention(gold), contains_abstention(prediction))
        .otherwise(same)
    )
    reason = (
        F.when(F.size(want) > 0, F.when(numeric, "number matched").otherwise("no number matched"))
        .when(contains_abstention(gold), F.when(contains_abstention(prediction), "abstention matched").otherwise("abstention missing"))
        .otherwise(F.when(same, "text matched").otherwise("text differs"))
    )
    return F.struct(hit.alias("is_match"), reason.alias("reason"))


def unsupported_numbers(said: Column, known: Column) -> Column:
    """Numbers of an answer (parsed) that match none of the known ones (parsed)."""
    return let(known, lambda ks: F.filter(said, lambda n: ~F.exists(ks, lambda k: numbers_match(n, k))))


def decimal_text(c: Column, places: int, commas: bool = False) -> Column:
    """Half-up rounding to ``places``, trailing zeros dropped, never ``-0``."""
    rounded = F.round(c, places)
    s = F.format_number(rounded, places)
    if not commas:
        s = F.replace(s, F.lit(","), F.lit(""))
    if places:
        s = F.regexp_replace(s, r"\.?0+$", "")
    return F.when(rounded == 0, "0").otherwise(s)


def gold_text(gold: Column, answer_type: Column) -> Column:
    """A raw gold as a natural answer: percentages to one place (fractions times 100), money to two with ``$``, numbers to two."""
    v = parse_decimal(gold)
    kind = F.lower(text(answer_type))
    hundred = F.when(F.abs(v) <= 1, v.cast("decimal(20,10)") * 100).otherwise(v).cast("decimal(38,10)")
    out = (
        F.when(kind == "percent", F.concat(decimal_text(hundred, 1), F.lit("%")))
        .when(kind == "currency", F.concat(F.lit("$"), decimal_text(v, 2, commas=True)))
        .otherwise(decimal_text(v, 2))
    )
    return F.when(v.isNull(), strip(text(gold))).otherwise(out)


def number_token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(text(c), F.lit(r"(?U)[-+]?\$?\d[\d,]*(?:\.\d+)?%?"), 0))
