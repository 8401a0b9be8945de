import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as num
from ledgerloom.functions import text as txt


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


MATCHES = [
    ("$1.2 million.", "1200000", True),
    ("16.4%.", "0.164", True),
    ("$41,932", "41932.20339", True),
    ("$41,932.20", "41932.20339", True),
    ("53.2%", "0.53232", True),
    ("15.4%", "16.4%", False),
    ("53.0%", "0.53232", False),
    ("Not enough information.", "insufficient information", True),
    ("12", "cannot determine", False),
    ("Yes", "yes", True),
    ("yes.", "yes", False),
    ("", "", True),
    (None, None, True),
    (None, "5", False),
]


def test_exact_match(spark):
    df = spark.createDataFrame([(p, g, w) for p, g, w in MATCHES], "p string, g string, w boolean")
    got = df.select("p", "g", "w", num.exact_match(F.col("p"), F.col("g"))["is_match"].alias("m")).collect()
    assert [(r.p, r.g, r.m) for r in got if r.m != r.w] == []


# an independent reading of the number grammar, for comparison
_SIMPLE = re.compile(
    r"(?<![A-Za-z0-9])([$€£])?\s*([-+])?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)\s*"
    r"(thousand|million|billion|trillion|mn|mm|bn|m|b|k)?\s*(%|percent|percentage\s+points?|points?|basis\s+points?|bps)?",
    re.I,
)
_POWERS = {"k": 3, "thousand": 3, "m": 6, "mn": 6, "mm": 6, "million": 6, "b": 9, "bn": 9, "billion": 9, "trillion": 12}


def brute_numbers(t):
    out = []
    for m in _SIMPLE.finditer(t or ""):
        raw = Decimal(m[3].replace(",", "")) * (-1 if m[2] == "-" else 1)
        out.append((m[0].strip(), raw * 10 ** _POWERS.get((m[4] or "").lower(), 0), (m[5] or "").lower() in ("%", "percent")))
    return out


def brute_match(a, b):
    def variants(n):
        v = {n[1]}
        raw = brute_numbers(n[0])[0]
        m = _SIMPLE.search(n[0])
        raw = Decimal(m[3].replace(",", "")) * (-1 if m[2] == "-" else 1)
        if m[4]:
            v.add(raw)
        if n[2]:
            v |= {n[1] / 100, raw / 100}
        return v

    for x in variants(a):
        for y in variants(b):
            larger = max(abs(x), abs(y))
            if abs(x - y) <= max(Decimal("0.0005") if larger < 1 else Decimal("0.005"), Decimal("0.001") * larger):
                return True
    return False


def test_numbers_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["$", "€ ", "-", "+", "(", ")", " ", "12", "1,234", "1,234.5", ".5", "0.25", " million", "bn", "k", "%", " percent", " bps", "abc", "5 months",
            "2022-2023", "10 basis points", "3 percentage points", " ", "7 thousand ", "999"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", num.extract_numbers(F.col("t")).alias("n")).collect():
        assert [(n.surface, n.value, n.is_percent) for n in r.n] == [(s, v, p) for s, v, p in brute_numbers(r.t)], r.t
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", num.unsupported_numbers(num.extract_numbers(F.col("a")), num.extract_numbers(F.col("b"))).alias("u")).collect()
    for r in got:
        known = brute_numbers(r.b)
        want = [n[0] for n in brute_numbers(r.a) if not any(brute_match(n, k) for k in known)]
        assert [n.surface for n in r.u] == want, (r.a, r.b)


def test_unsupported(spark):
    u = lambda a, c: one(spark, F.transform(num.unsupported_numbers(num.extract_numbers(F.col("a")), num.extract_numbers(F.col("c"))), lambda n: n["surface"]), a=a, c=c)
    assert u("$11 million", "It was $10 million") == ["$11 million"]
    assert u("2.3 points", "2.3") == []


@pytest.mark.parametrize(
    "t,want",
    [
        ("Because of this\nFinal answer: 12.4%", ("12.4%", True)),
        ("It is 12.4%", ("It is 12.4%", False)),
        ("Final answer:\n\n  7 \n8", ("7", True)),
        ("Final answer:", ("", True)),
        (None, ("", False)),
        ("\x0bFINAL ANSWER :  x  ", ("x", True)),
    ],
)
def test_final_answer(spark, t, want):
    r = one(spark, txt.final_answer(F.col("t")), t=t)
    assert (r.answer, r.found) == want


@pytest.mark.parametrize(
    "t,want", [("\n\nFinal answer: 5\n \n", True), ("Final answer: 5\nmore", False), ("Final answer:", False), ("x", False), (None, False)]
)
def test_strict(spark, t, want):
    assert one(spark, txt.strict_format(F.col("t")), t=t) is want


@pytest.mark.parametrize(
    "gold,kind,want",
    [("0.53232", "percent", "53.2%"), ("41932.20339", "currency", "$41,932.2"), ("127.40000", "number", "127.4"), ("0.5%", "percent", "50%"),
     ("-0.0004", "number", "0"), ("yes", "text", "yes"), (None, "percent", ""), ("0.125", "number", "0.13"), ("250", "percent", "250%")],
)
def test_gold_text(spark, gold, kind, want):
    assert one(spark, num.gold_text(F.col("g"), F.col("k")), g=gold, k=kind) == want


def test_small_texts(spark):
    assert one(spark, txt.excerpt(F.col("t"), 10), t="  a   b c  ") == "a b c"
    assert one(spark, txt.excerpt(F.col("t"), 10), t="abcdefghijklmnop") == "abcdefg..."
    assert one(spark, txt.normalize_answer(F.col("t")), t="  It's  $5.00! ") == "it s $5.00"
    assert one(spark, txt.contains_abstention(F.col("t")), t="We CAN'T determine it") is True
    assert one(spark, F.size(txt.ngrams(txt.tokens(F.col("t")), 3)), t="one two") == 0
    assert one(spark, txt.first_text(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"
