from decimal import Decimal

import pytest

from ledgerloom.functions import quantities as qty
from ledgerloom.functions import questions
from ledgerloom.functions.replies import is_abstention, language, stated_result
from ledgerloom.operators import units

PAGE = """Pre-text:
The company reported results. Reporting currency: EUR. Amounts are in thousands.

Table:
 | 2014 | 2013
net revenue | 120.5 | 100.0
ore shipped (kt) | 40 | 50
goodwill (in $mm) | 3 | 2
stock held (thousands of shares) | 10 | 12

Post-text:
A loan of 8 years was renewed in 2014."""


@pytest.mark.parametrize(
    "text,figure,scale,unit",
    [
        ("$1,765.3", "1765.3", None, "usd"),
        ("USD −174,170 thousand", "-174170", 3, "usd"),
        ("\t-€ 46.7 mm ", "-46.7", 6, "eur"),
        ("$(9.7) M", "-9.7", 6, "usd"),
        ("432,400,000 in whole dollars", "432400000", 0, "usd"),
        ("(24.057)%", "-24.057", None, "percent"),
        ("236 862", "236862", None, None),
        ("11.3k sq ft", "11.3", 3, "sqft"),
        ("-3,876 bps", "-3876", None, "percent"),
        ("9388 kilotonnes", "9388", None, "tonne"),
    ],
)
def test_parse_quantity(text, figure, scale, unit):
    q = qty.parse_quantity(text)
    assert (q.figure, q.scale, q.unit) == (Decimal(figure), scale, unit)


@pytest.mark.parametrize("text", ["yes", "", None, "approximately $", "between 5 and 6", "the change was", "$", "2013 and 2014"])
def test_no_quantity(text):
    assert qty.parse_quantity(text) is None


@pytest.mark.parametrize(
    "gold,question,unit,amount",
    [
        ("20.5", "what was the change in net revenue of X from 2013 to 2014?", "eur", 20_500_000),
        ("$20.5", "what was the change in net revenue of X from 2013 to 2014?", "usd", 20_500_000),
        ("20.5", "what was the change in net revenue from 2013 to 2014 (in millions of dollars)?", "usd", 20_500_000_000),
        ("0.205", "what was the percentage change in net revenue of X from 2013 to 2014?", "percent", 20_500),
        ("20.5%", "by what percent did net revenue change between 2013 and 2014?", "percent", 20_500),
        ("-10", "by how much did ore shipped for X change between 2013 and 2014?", "tonne", -10_000_000),
        ("-10,000 t", "by how much did ore shipped for X change between 2013 and 2014?", "tonne", -10_000_000),
        ("1", "by how much did goodwill for X change between 2013 and 2014?", "usd", 1_000_000_000),
        ("-2", "by how much did stock held for X change between 2013 and 2014?", "share", -2_000_000),
        ("1.5 GWh", "how much power purchased?", "mwh", 1_500_000),
        ("300 bps", "what is the growth rate of net revenue", "percent", 3_000),
    ],
)
def test_solve(gold, question, unit, amount):
    s = units.solve(gold, question, units.LazyPage(PAGE))
    assert (s.unit, s.amount) == (unit, amount)


def test_ratio_and_yes_no_are_no_quantity():
    page = units.LazyPage(PAGE)
    assert units.solve("1.205", "what was the ratio of net revenue in 2014 to 2013 for X?", page) is None
    assert units.solve("1.2x", "how many times the 2013 level was net revenue in 2014?", page) is None
    assert units.solve("yes", "did net revenue in 2014 exceed that of 2013?", page) is None


CHANGE = "what was the change in net revenue of X from 2013 to 2014?"


def implied(*values):
    return [units.Reading("eur", Decimal(v), s, 3) for v, s in values]


def test_identity_flags_doubt():
    page = units.LazyPage(PAGE)
    values = units.program_values("subtract(120.5, 100.0)", CHANGE, page, None)
    assert [(v.unit, v.value) for v in values] == [("eur", Decimal("20500.0"))]
    assert units.solve("20.5", CHANGE, page, values).unique
    # the asked scale is in the value's own question, the program's in the page: one fact, two scales
    far = units.solve("0.0205", CHANGE + " in millions of euros", page, values)
    assert (far.amount, far.scale, far.unique, far.nearest) == (20_500_000, 6, True, True)
    none = units.solve("77", CHANGE, page, values)
    assert (none.amount, none.unique) == (77_000_000, False)


def test_identity_overrules_the_nearest_evidence():
    """The head says millions, a sentence thousands; the program fits the one with which the value agrees."""
    page = units.LazyPage(PAGE.replace(" | 2014 | 2013", "EUR millions | 2014 | 2013"))
    assert [v.scale for v in units.program_values("subtract(120.5, 100.0)", CHANGE, page, None)] == [6, 3]
    s = units.solve("20.5", CHANGE, page, implied(("20500", 3)))
    assert (s.amount, s.scale, s.level, s.nearest, s.unique) == (20_500_000, 3, 4, False, True)
    # without an identity the nearest evidence is taken, and the doubt is said
    s = units.solve("20.5", CHANGE, page)
    assert (s.scale, s.level, s.nearest, s.unique) == (6, 3, True, False)
    # a value that fits in no reading is wrong, not in another unit
    s = units.solve("3.1", CHANGE, page, implied(("20500", 3)))
    assert (s.scale, s.nearest) == (6, True)


def test_figure_written_out_in_full():
    page = units.LazyPage(PAGE.replace("thousands", "billions"))
    values = units.program_values("subtract(2234.0, 1000.0)", CHANGE, page, None)
    s = units.solve("1,234,000,000,000", CHANGE, page, values)
    assert (s.amount, s.scale, s.nearest, s.unique) == (1_234_000_000_000_000, 0, False, True)


def test_beyond_64_bits():
    page = units.LazyPage(PAGE.replace("thousands", "billions"))
    s = units.solve("12,345,678,901", CHANGE, page)  # in billions it would not fit
    assert (s.amount, s.scale, s.nearest) == (12_345_678_901_000, 0, False)
    s = units.solve("12,345,678,901 billion", CHANGE, page)
    assert (s.amount, s.exact) == (None, "12345678901" + "0" * 12)
    s = units.solve("1000000000000001", CHANGE, units.LazyPage(None), [], "eur")
    assert s.amount == 1_000_000_000_000_001_000
    assert units.solve("9" * 6000, CHANGE, units.LazyPage(None), [], "eur").exact == "9" * 6000 + "000"
    assert units.solve("0", CHANGE, page, implied(("0", 9))).residual == 0


def test_fraction_rule_is_kept_but_flagged():
    q = "what was the percentage change in net revenue of X from 2013 to 2014?"
    page = units.LazyPage(PAGE)
    values = units.program_values("subtract(120.5, 100.0), divide(#0, 100.0)", q, page, None)
    assert units.solve("0.205", q, page, values).unique
    s = units.solve("20.5", q, page, values)
    assert (s.amount, s.unique) == (2_050_000, False)


def test_column_edges(spark):
    schema = "row_id long, id string, gold string, question string, context string, program string, metadata struct<filename: string>, unit string, rec_no int"
    issuers = spark.createDataFrame([("AB", None, "GBP"), (None, "X", "USD"), ("AB", None, "GBP")], "issuer_code string, former_code string, home_currency string")
    rows = [
        (1, "AB/2014/page_1.pdf-1", "5", "what was the change in y from 2013 to 2014?", None, None, None, "clash", 0),
        (2, None, None, None, None, None, None, None, None),
        (3, None, "7%", None, None, None, ("zz",), None, None),
        (3, None, "7%", None, None, None, ("zz",), None, None),
        (4, "AB/2014/page_1.pdf-1", "5 " * 50_000, "q", "c" * 100_000, None, None, None, None),
        (5, None, "1" * 40, "what?", "", "", None, None, None),
        (6, None, "$" + "1" * 40, "what?", "", "", None, None, None),
    ]
    got = units.gold_quantities(spark.createDataFrame(rows, schema), issuers).collect()
    assert sorted((r.rec_no, r.unit, r.amount) for r in got) == [(1, "gbp", 5000), (3, "percent", 7000), (3, "percent", 7000), (6, "usd", None)]
    assert units.gold_quantities(spark.createDataFrame([], schema)).count() == 0
    p = "pred_no long, id string, gold string, tuned_answer string, base_answer string, question string, context string"
    rows = [
        (1, None, "20.5%", "Final answer: 20.5%", "The answer is 21%.", "by what percent did a change between 2013 and 2014?", None),
        (2, None, "cannot determine", "12%", None, "by what percent did a change between 2013 and 2014?", None),
        (3, None, None, None, "Das Ergebnis ist 20 %, berechnet aus den Werten.", "by what percent did a change?", None),
    ]
    got = units.answer_quantities(spark.createDataFrame(rows, p)).collect()
    assert sorted((r.rec_no, r.field, r.amount) for r in got) == [(1, "base_answer", 21000), (1, "tuned_answer", 20500)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("**Final answer:** 32.5%", "32.5%"),
        ('{"answer": "1.02"}', "1.02"),
        ("The relative change for x of Y (2010 to 2011) is -11.455%.", "-11.455%"),
        ("Moved from $ 5 (2010) to $ 6 (2011). The answer is $1.", "$1"),
        ("The value works out to -$1,456.46 k based on the filing.", "-$1,456.46 k"),
        ('{"answer": "1.02', None),
        (None, None),
    ],
)
def test_stated_result(text, want):
    got = stated_result(text)
    assert (got.rstrip(".") if got else got) == want


def test_languages():
    assert language("Das Ergebnis ist 5 %, berechnet aus den beiden Jahreswerten.") == "de"
    assert language("Si on divise les deux montants, on obtient -13.6 per cent.") == "fr"
    assert language("The answer is 5.") == "en"
    assert language("최종 답은 5 입니다") == "ko"
    assert language("12.5 %") is None and language(None) is None
    assert is_abstention("There is not enough information.") and not is_abstention("5")


def test_question_forms():
    a = questions.canonical("What was the percentage change in net revenue of the Gures retail tools business from 2010 to 2011?")
    b = questions.canonical("Q. how did Some Corp's net revenue in Gures retail tools change from 2010 to 2011, as a percentage? (see page)")
    c = questions.canonical("Um wie viel Prozent veränderte sich net revenue im Geschäft Gures retail tools von 2010 bis 2011?")
    assert a == b == c
    assert a != questions.canonical("What was the change in net revenue of the Gures retail tools business from 2010 to 2011?")
    assert a != questions.canonical("What was the percentage change in net revenue of the Gures retail tools business from 2010 to 2012?")
    assert questions.canonical(None) is None and questions.canonical("  ") is None
