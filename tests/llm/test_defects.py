import pytest

from ledgerloom.llm import defects

Q = "what was the change in goodwill of the Gures retail tools business from 2010 to 2011?"
DE = "Um wie viel Prozent veränderte sich goodwill im Geschäft Gures retail tools von 2010 bis 2011?"


@pytest.mark.parametrize(
    "text,gold,question,want",
    [
        (None, "5", Q, "empty"),
        (" \n​", "5", Q, "empty"),
        ("**Final answer:**", "5", Q, "empty"),
        ("<answer></answer>", "5", Q, "empty"),
        ('{"answer": ""}', "5", Q, "empty"),
        ("N/A", "5", Q, "empty"),
        ("..", "5", Q, "empty"),
        ('{"answer": "5', "5", Q, "truncated"),
        ("First take 130, which is then divided by", "5", Q, "truncated"),
        ("The table lists goodwill of $ 5 in 2010. Subtracting gives the movement. The answer is", "5", Q, "truncated"),
        ("The company cannot offset these amou", "5", Q, "truncated"),
        ("approximately $", "5", Q, "truncated"),
        ("Apologies: I must decline to compute this.", "5", Q, "refusal"),
        ("There is not enough information to determine this.", "5", Q, "refusal"),
        ("There is not enough information to determine this.", "cannot determine", Q, None),
        ("Ich kann diese Frage leider nicht beantworten.", "5", DE, "refusal"),
        ("Q: " + Q, "5", Q, "copies_question"),
        (Q + "\n" + Q, "5", Q, "copies_question"),
        (Q[:70], "5", Q, "copies_question"),
        (Q.upper(), "5", Q, "copies_question"),
        ("Das Ergebnis ist 5 %, berechnet aus den beiden Jahreswerten.", "5", Q, "other_language"),
        ("The value works out to 5% based on the filing.", "5", DE, "other_language"),
        ("Das Ergebnis ist 5 %, berechnet aus den beiden Jahreswerten.", "5", DE, None),
        ("최종 답은 5 입니다", "5", Q, "other_language"),
        ("Final answer: no.", "no", Q, None),
        ("Final answer: 5", "7", Q, None),
        ("Sorry for the earlier slip: the right rows show 5 for 2010 and 6 for 2011. The answer is 1.", "1", Q, None),
        ("The movement for goodwill of Gures retail tools (2010 to 2011) is $601.5.", "5", Q, None),
        ("5", "5", None, None),
    ],
)
def test_reply(text, gold, question, want):
    found = defects.defects(text, question, gold, True)
    assert (found[0] if found else None) == want


@pytest.mark.parametrize(
    "text,question,want",
    [
        ("Ich kann diese Frage leider nicht beantworten (siehe", Q, ["refusal", "truncated", "other_language"]),
        ("Ich kann diese Frage leider nicht beantworten.", Q, ["refusal", "other_language"]),
        ("I must decline to compute this because of", Q, ["refusal", "truncated"]),
        ("Q: " + Q + " (see", Q, ["copies_question", "truncated"]),
        (Q + " " + Q + " I cannot say.", Q, ["copies_question", "refusal"]),
        ("Das Ergebnis ist 5 %, berechnet aus den beiden Jahreswerten (", Q, ["truncated", "other_language"]),
    ],
)
def test_every_defect_comes_out(text, question, want):
    assert defects.defects(text, question, "5", True) == want


def test_abstention_where_the_gold_abstains_is_no_defect():
    assert defects.defects("Ich kann diese Frage leider nicht beantworten.", Q, "cannot determine", True) == []


@pytest.mark.parametrize("text,want", [("not enough inf", "truncated"), ("between 5 and", "truncated"), ("-$", "truncated"), ("-", "empty"), ("[]", "empty"),
                                       ("not enough information", None), ("no", None), (Q, "copies_question"), ("$5", None)])
def test_gold(text, want):
    found = defects.defects(text, Q, text, False)
    assert (found[0] if found else None) == want


def test_frame(spark):
    schema = "pred_no long, question string, gold string, tuned_answer string, defect string, nth int"
    rows = [(1, Q, "5", None, "clash", 9), (1, Q, "5", None, None, None), (2, None, None, None, None, None), (3, Q, "5", "word " * 100_000 + "The answer is 5.", None, None)]
    got = sorted((r.pred_no, r.field, r.defect) for r in defects.broken_pairs(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "tuned_answer", "empty")] * 2 + [(2, "gold", "empty"), (2, "tuned_answer", "empty")]
    assert defects.broken_pairs(spark.createDataFrame([], schema)).count() == 0
    assert defects.defect_report(defects.broken_pairs(spark.createDataFrame(rows, schema))).count() == 2
