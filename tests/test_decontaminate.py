import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import decontaminate as dec


def grams(t, n):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def texts(rng, n):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    standard = "this is standard wording that every second text repeats in full"
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        out.append(t + (" " + standard if rng.random() < 0.5 else ""))
    return out + [None, "", "alpha"]


def run(spark, threshold, n=3):
    rng = random.Random(11)
    cand = list(enumerate(texts(rng, 60)))
    prot = [(i % 15, t) for i, t in enumerate(texts(rng, 30))]  # ids repeat: merged
    c = spark.createDataFrame([(k, t, 0) for k, t in cand], "k long, t string, grams int")
    p = spark.createDataFrame(prot, "item long, t string")
    got = {r.k: (r.removed, r.max_overlap, r.matched_item) for r in dec.decontaminate(c, p, "k", "t", "item", "t", n, threshold).collect()}
    merged = {}
    for i, t in prot:
        merged.setdefault(i, set()).update(grams(t, n))
    want = {}
    for k, t in cand:
        g = grams(t, n)
        best = max(((len(g & m) / len(g), -i) for i, m in merged.items() if g & m), default=None) if g else None
        best = best if best and best[0] >= threshold else None
        removed = best is not None or threshold <= 0
        want[k] = (removed, round(best[0], 9) if best else 0.0, (str(-best[1]) if best else "none") if removed else None)
    return got, want


def test_against_brute_force(spark):
    for threshold in (0.5, 0.2, 0.05, 0.0):
        got, want = run(spark, threshold)
        assert got == want, threshold


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 500)
    for threshold in (0.5, 0.05):
        got, want = run(spark, threshold)
        assert got == want, threshold


@pytest.mark.parametrize("gather", (0, 50_000))
def test_items_of_classes(monkeypatch, gather):
    monkeypatch.setattr(dec, "GATHER", gather)
    rng = random.Random(5)
    items = {c: sorted(rng.sample(range(400), size)) for c, size in enumerate([1, 2, 3, 5, 8, 300, 390])}
    block = dec.Block(pa.table([pa.array([c * 7 for c in items for _ in items[c]]), pa.array([i for c in items for i in items[c]])], names=["cls", "item"]))
    for _ in range(50):
        classes = rng.sample(range(7), rng.randint(1, 7))
        n = [rng.randint(1, 9) for _ in classes]
        need = rng.randint(1, sum(n))
        sums = {}
        for c, m in zip(classes, n):
            for i in items[c]:
                sums[i] = sums.get(i, 0) + m
        got = block.shared(np.array(classes), np.array(n), need)
        found = dict(zip(block.names.take(pa.array(got[0])).to_pylist(), got[1].astype(int).tolist()))
        assert found == {i: s for i, s in sums.items() if s >= need}


def test_only_few_protected_ngrams_are_broadcast(spark, monkeypatch):
    told, broadcast = [], F.broadcast
    monkeypatch.setattr(session.F, "broadcast", lambda df: (told.append(df.count()), broadcast(df))[1])
    words = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("w"), (F.col("id") * 20 + i).cast("string")))
    p = spark.range(25_000).select("id", F.array_join(words, " ").alias("t"))
    r = dec.decontaminate(p.where("id % 5000 = 1"), p, "id", "t", "id", "t", 3, 0.5).collect()
    assert {(x.id, x.matched_item, x.max_overlap) for x in r} == {(i, str(i), 1.0) for i in range(1, 25_000, 5000)}
    assert all(n < 350_000 for n in told)  # 450,000 n-grams in all


def test_identical_texts(spark):
    c = spark.createDataFrame([("a", "one two three four five six")], "id string, t string")
    p = spark.createDataFrame([("p", "One, two three. Four five SIX!")], "id string, t string")
    r = dec.decontaminate(c, p, "id", "t", "id", "t", 3, 0.5).first()
    assert (r.removed, r.matched_item, r.max_overlap) == (True, "p", 1.0)
    assert dec.decontaminate(c.limit(0), p, "id", "t", "id", "t").count() == 0
    assert dec.decontaminate(c, p.limit(0), "id", "t", "id", "t").first().removed is False


def test_overlap_function(spark):
    df = spark.createDataFrame([("a b c d", "a b c x"), ("a", "a b c")], "l string, r string")
    assert [r.o for r in df.select(dec.ngram_overlap(F.col("l"), F.col("r"), 3).alias("o")).collect()] == [0.5, 0.0]
