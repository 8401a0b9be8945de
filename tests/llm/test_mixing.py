import random
from collections import Counter

import pytest

from ledgerloom.llm import mixing

DOCS = "doc_id long, text string, source string, tokens long, position long"
TARGETS = "mix_id int, source string, target_share double, max_repeats int, total_frac double"


def make(spark, n=400):
    rng = random.Random(5)
    names = ["report", "Report ", "REPORT", "news_wire", "NewsWire", "news wire", "chat", None]
    rows = [(i, " ".join(["word"] * rng.randint(0, 60)) if i % 37 else None, "report" if rng.random() < 0.34 else rng.choice(names), 0, 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_budgets(spark):
    rows, df = make(spark)
    targets = [(1, "report", 0.5, 1, 0.5), (1, "news_wire", 0.3, 2, 0.5), (1, "chat", 0.2, 4, 0.9), (2, "chat", 1.0, 3, 1.0), (2, "absent", 0.0, 3, 1.0),
               (3, "report", 1.0, 5, 2.0), (None, "chat", 1.0, 1, 1.0), (4, "chat", 0.01, None, 1.0)]
    selection, report = mixing.mix_sources(df, spark.createDataFrame(targets, TARGETS))
    size = {r[0]: len(r[1].split()) if r[1] else 0 for r in rows}  # one token each
    total = sum(size.values())
    have = Counter()
    for r in rows:
        have[(r[2] or "").lower().replace("_", "").replace(" ", "")] += size[r[0]]
    got = {(r.mix_id, r.source): r for r in report.collect()}
    used = selection.collect()
    assert len({(r.mix_id, r.doc_id) for r in used}) == len(used)
    biggest = max(size.values())
    for mix, source, share, reps, frac in targets:
        if mix is None:
            continue
        r = got[mix, source]
        available = have[source.replace("_", "")]
        want = share * frac * total
        assert r.available == available and r.wanted == pytest.approx(want, abs=1e-5)
        assert r.short == (available * (reps or 0) < want - 1e-9)
        given = sum(x.tokens * x.repeats for x in used if x.mix_id == mix and x.source_key == source.replace("_", ""))
        assert given == r.given and max([x.repeats for x in used if x.mix_id == mix and x.source_key == source.replace("_", "")], default=0) <= (reps or 0)
        assert given == available * (reps or 0) if r.short else abs(given - want) <= biggest
    for mix in (1, 2, 3):
        assert sum(r.actual_share or 0 for k, r in got.items() if k[0] == mix) == pytest.approx(1, abs=1e-6)
    again = mixing.mix_sources(df, spark.createDataFrame(targets, TARGETS))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, used))


def test_edges(spark):
    _, df = make(spark, 20)
    targets = spark.createDataFrame([(1, "report", 1.0, 2, 0.5)], TARGETS)
    selection, report = mixing.mix_sources(df.limit(0), targets)
    assert selection.count() == 0 and report.first().given == 0
    selection, report = mixing.mix_sources(df, targets.limit(0))
    assert selection.count() == 0 and report.count() == 0


def test_tokens(spark):
    import tiktoken

    enc = mixing._encoding(mixing.TOKENIZER)
    assert isinstance(enc, tiktoken.Encoding)
    for t in ("Net revenue came to $ 164.9 million.", "  two  spaces ", "über 日本", "x" * 5000):
        assert enc.decode(enc.encode_ordinary(t)) == t
    got = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(mixing.token_count(__import__("pyspark").sql.functions.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [2, 0, 0]
