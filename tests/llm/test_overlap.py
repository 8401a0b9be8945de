import random

from ledgerloom.functions.questions import canonical
from ledgerloom.functions.strings import deletions, edits
from ledgerloom.llm import overlap

SCHEMA = "row_id long, source_split string, dataset string, question string, hash long, canon string"


def ask(business, measure, a, b, form=0):
    forms = [
        f"what was the percentage change in {measure} of the {business} business from {a} to {b}?",
        f"In percent, how much did {measure} for {business} move from {a} to {b}",
        f"Q. according to the table, considering the years {a} and {b}, what was the percentage movement in {measure} of {business}? (see page)",
        f"Um wie viel Prozent veränderte sich {measure} im Geschäft {business} von {a} bis {b}?",
    ]
    return forms[form % 4]


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    truth, rows = {}, []
    for i in range(400):
        key = (rng.choice(["Gures retail tools", "Fomber online textile systems"]), rng.choice(["net revenue", "goodwill", "service fees"]), rng.choice([2010, 2011]), rng.choice([2013, 2014]))
        q = ask(*key, rng.randint(0, 3))
        if i == 77:
            q = q.replace("a", "A").replace("e", "E")
        split = rng.choice(["train", "TRAIN ", "training", "dev", "valid", "Test", None])
        truth[i] = (key, None if split is None else "train" if split.lower().startswith("train") else "held")
        rows.append((i, split, "d", q, 0, "clash"))
    rows += [(1000, "dev", "d", None, None, None), (1001, "train", "d", None, None, None), (1002, "dev", None, " ", None, None)]
    pairs, canon = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA))
    got = [(r.row_id_a, r.row_id_b) for r in pairs.collect()]
    want = {(min(a, b), max(a, b)) for a in truth for b in truth if truth[a][0] == truth[b][0] and truth[a][1] == "train" and truth[b][1] == "held"}
    assert len(got) == len(set(got)) and set(got) == want
    report = overlap.overlap_report(canon).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert sum(r.leaked_rows for r in report) == len({x for p in want for x in p if truth[x][1] == "held"})


def test_misspellings_are_repaired(spark):
    rows = [(i, "train", "d", ask("Gures industrial ceramic tools", "net revenue", 2010, 2011 + i % 3, i), 0, None) for i in range(240)]
    rows.append((900, "dev", "d", "what was the percetnage chagne in net revvenue of the Gures inddustrial carmic tools buiness from 2010 to 2011?", 0, None))
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA))[0].collect()
    assert {r.row_id_a for r in got} == {i for i in range(240) if i % 3 == 0} and {r.row_id_b for r in got} == {900}


def test_copies_do_not_make_a_misspelling_usual(spark):
    """One misspelt question holds a third of all rows; the right words stand in many different questions."""
    rows = [(i, "train", "d", ask("Gures industrial ceramic tools", "net revenue", 1960 + i % 60, 2021, 0), 0, None) for i in range(240)]
    wrong = "what was the percentage change in net revvenue of the Gures industrial ceramic tools business from 1970 to 2021?"
    rows += [(900 + i, "dev", "d", wrong if i % 2 else wrong.upper(), 0, None) for i in range(120)]
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA))[0].collect()
    want = {(a, b) for a in range(10, 240, 60) for b in range(900, 1020)}
    assert {(r.row_id_a, r.row_id_b) for r in got} == want


def test_many_misspellings_are_joined(spark, monkeypatch):
    monkeypatch.setattr(overlap, "TOLD_ROWS", 0)
    test_misspellings_are_repaired(spark)


def test_different_questions_stay_apart():
    pairs = [
        ("what was the change in plan assets from 2018 to 2019?", "what was the change in assets from 2018 to 2019?"),
        ("what was Acme's revenue change from 2018 to 2019?", "what was Beta's revenue change from 2018 to 2019?"),
        ("what was the change in net revenue from 2018 to 2019?", "what was the change in net revenue from 2019 to 2018?"),
        ("what was the percent change in mean level of inventory from 2018 to 2019?", "what was the percent change in inventory from 2018 to 2019?"),
    ]
    assert all(canonical(a) != canonical(b) for a, b in pairs)
    one = "how much higher or lower was Acme's Gures retail tools net revenue in 2022 than in 2020?"
    assert canonical(one) == canonical(one.replace("Acme's ", "")) == canonical("what was the change in net revenue of the Gures retail tools business from 2020 to 2022?")


def test_plain_rows_of_the_report(spark):
    q = ask("Gures retail tools", "net revenue", 2010, 2011)
    rows = [(1, "train", "d", q, 0, None), (2, "dev", "d", q.upper() + " !", 0, None), (3, "dev", "d", ask("Gures retail tools", "net revenue", 2010, 2011, 1), 0, None), (4, "dev", "d", None, 0, None)]
    r = overlap.overlap_report(overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA))[1]).first()
    assert (r.eval_rows, r.plain_rows, r.leaked_rows, r.pairs) == (3, 1, 2, 2)


def test_empty(spark):
    pairs, canon = overlap.cross_split_pairs(spark.createDataFrame([], SCHEMA))
    assert pairs.count() == 0 and overlap.overlap_report(canon).count() == 0


def test_edits():
    assert [edits(a, b, 2) for a, b in (("abc", "abc"), ("abcd", "abdc"), ("abc", "abx"), ("goods", "gods"), ("abc", "xyz"))] == [0, 1, 1, 1, 3]
    assert deletions("ab", 1) == {"ab", "a", "b"}
