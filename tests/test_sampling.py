import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from ledgerloom.operators import sampling
from ledgerloom.operators.ranking import label_by_rank, random_key
from ledgerloom.functions.labels import category, issuer_code, split_name
from pyspark.sql import functions as F


def key(seed, k):
    return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()


def rows(spark, n=700, seed=1):
    rng = random.Random(seed)
    # one stratum holds more than a third of all rows
    data = [(i, rng.choice(["a", "a", "a", "b", None, "c"]), "clash", 0) for i in range(n)]
    return data, spark.createDataFrame(data, "k long, g string, bucket string, upto int")


def test_stratified_split_against_brute_force(spark):
    data, df = rows(spark)
    got = {r.k: r.split for r in sampling.stratified_split(df.select("k", "g"), "g", "k").collect()}
    groups = defaultdict(list)
    for k, g, *_ in data:
        groups[g].append(k)
    want = {}
    for g, ks in groups.items():
        ks.sort(key=lambda k: (key(13, k), k))
        n = len(ks)
        a, b = math.floor(n * 0.8), math.floor(n * 0.1)
        for i, k in enumerate(ks):
            want[k] = "train" if i < a else "validation" if i < a + b else "test"
    assert got == want
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "g", "k", {"a": 0.5, "b": 0.4})


def test_quota_sample_against_brute_force(spark):
    data, df = rows(spark)
    got = sampling.quota_sample(df.select("k", "g"), "g", "k", {"a": 20, "b": 10, "zz": 5}, 50, seed=7, strict=True).collect()
    order = sorted(data, key=lambda r: (key(7, r[0]), r[0]))
    want = {r[0]: r[1] for g, n in (("a", 20), ("b", 10)) for r in [x for x in order if x[1] == g][:n]}
    rest = [r[0] for r in order if r[0] not in want][: 50 - len(want)]
    want |= {k: "fallback" for k in rest}
    assert {r.k: r.bucket for r in got} == want
    with pytest.raises(sampling.ShortfallError):
        sampling.quota_sample(df.select("k", "g"), "g", "k", {"a": 20}, 5000)
    assert sampling.quota_sample(df.limit(0).select("k", "g"), "g", "k", {"a": 2}, 5, strict=False).count() == 0


def test_bucket_sample_takes_each_id_once(spark):
    rng = random.Random(4)
    tags = ["x", "y", "z"]
    data = [(i, str(i // 2), [t for t in tags if rng.random() < 0.5]) for i in range(300)]
    df = spark.createDataFrame(data, "k long, id string, tags array<string>")
    got = sampling.bucket_sample(df, "tags", "k", {"x": 20, "y": 30, "z": 0}, 70, seed=21, id_column="id").collect()
    assert len(got) == 70
    ids = Counter(r.id for r in got if r.bucket != "fallback")
    assert max(ids.values()) == 1
    assert Counter(r.bucket for r in got) == {"x": 20, "y": 30, "fallback": 20}
    order = sorted(data, key=lambda r: (key(21, r[0]), r[0]))
    seen, first = set(), []
    for k, i, t in order:
        if "x" in t and i not in seen and len(first) < 20:
            seen.add(i)
            first.append(k)
    assert {r.k for r in got if r.bucket == "x"} == set(first)
    with pytest.raises(sampling.ShortfallError):
        sampling.bucket_sample(df, "tags", "k", {"x": 1}, 1000)


def test_sample_rows_excluded_elsewhere(spark):
    data = [(1, "1", ["s", "p"]), (2, "2", ["p"]), (3, "3", ["s"])]
    df = spark.createDataFrame(data, "k long, id string, tags array<string>").where("id <> '1'")
    got = {r.k: r.bucket for r in sampling.bucket_sample(df, "tags", "k", {"s": 1, "p": 1}, 2).collect()}
    assert got == {3: "s", 2: "p"}


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(i, "g", "same") for i in range(30)], "k long, g string, key string")
    bounds = spark.createDataFrame([("g", 10, "low"), ("g", 12, "mid")], "g string, upto long, label string")
    got = {r.k: r.label for r in label_by_rank(df, ["g"], "key", "k", bounds, "label").collect()}
    assert got == {**{i: "low" for i in range(10)}, 10: "mid", 11: "mid"}


def test_answer_order(spark):
    df = spark.range(400).select(sampling.answer_order(F.lit("x"), F.lit("y"), F.col("id")).alias("o"), random_key(1, "id").alias("r"))
    got = df.collect()
    assert 150 < sum(r.o.swapped for r in got) < 250
    assert all({r.o.shown_a, r.o.shown_b} == {"x", "y"} and (r.o.shown_a == "y") == r.o.swapped for r in got)


@pytest.mark.parametrize(
    "path,code",
    [("EEW/2019/full_report.pdf-21", "EEW"), ("lmbw-2015-page_94.pdf", "LMBW"), ("LXPE%2F2019%2Fpage_113.pdf", "LXPE"), ("filings//AGQ/2018/page_2.pdf", "AGQ"),
     ("file:///data/TBVZ/2021/page_33.pdf", "TBVZ"), ("BNKN\\2013\\page_211.pdf", "BNKN"), (" AIWC / 2011 / page_52.pdf ", "AIWC"),
     ("WLXV_2008_page_70.pdf", "WLXV"), ("rec000000819", None), (None, None), ("", None)],
)
def test_issuer_code(spark, path, code):
    assert spark.createDataFrame([(path,)], "p string").select(issuer_code(F.col("p")).alias("c")).first().c == code


def test_labels(spark):
    values = ["Multi Step", "multi-step", "MULTI_STEP ", "pct", "%", None, "", "TRAINING", "valid", "dev "]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(category(F.col("v")).alias("c"), split_name(F.col("v")).alias("s")).collect()
    assert [r.c for r in got[:7]] == ["multistep"] * 3 + ["percent", "percent", None, None]
    assert [r.s for r in got[7:]] == ["train", "dev", "dev"]
