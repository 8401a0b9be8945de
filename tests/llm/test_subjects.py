import random

import numpy as np

from ledgerloom.llm import subjects as sub

WORDS = {"law": "court judge verdict appeal counsel statute".split(), "sport": "match goal stadium season coach league".split()}
COMMON = "revenue margin dividend quarter outlook costs".split()


def document(rng, about):
    lines = [" ".join(["the"] + rng.sample(COMMON, 4)) + "." for _ in range(6)]
    for s in about:
        lines += [" ".join(rng.sample(WORDS[s], 4)) + "." for _ in range(3)]
    rng.shuffle(lines)
    return " ".join(lines)


def make(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        about = [s for s in WORDS if rng.random() < 0.3]
        out.append((i, document(rng, about), about))
    return out


def test_sentences():
    assert sub.sentences("One two three. Four <b>five</b> six!\n\nre-\ncovered the loss 12,5") == ["one two three", "four five six", "recovered the loss"]
    assert sub.sentences(None) == [] and sub.sentences("12 | 13") == []


def test_gradient_is_the_derivative():
    block = sub.Block(sub.count_sentences([("aa bb cc. dd aa bb.", ["law"]), ("ee ff gg.", [])], ["law", "sport"]), 64)
    m = sub.new_model(["law", "sport"], 64, 3)
    g, loss, weight = block.gradient(m)
    assert weight == 3
    rng = np.random.default_rng(0)
    for k in "ewb":
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in m[k].shape)
            up = {x: (v.copy() if x in "ewb" else v) for x, v in m.items()}
            up[k][at] += 1e-6
            assert abs((block.gradient(up)[1] - loss) / 1e-6 - g[k][at]) < 1e-3


def test_held_out_accuracy_and_partitions(spark):
    train, held = make(300, 1), make(200, 2)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in train] + [(1000 + i, t, 0) for i, t, _ in held] + [(5000, None, 0), (5001, "", 0), (5002, "x " * 200_000, 0)], "doc_id long, text string, sentences int")
    labels = [(i, s if i % 3 else f" {s.upper()}") for i, _, a in train for s in a] + [(i, "none") for i, _, a in train if not a] + [(None, "law"), (7, None), (7777, "law")]
    labels = spark.createDataFrame(labels + labels[:20], "doc_id long, subject string")
    model = sub.fit(docs, labels, steps=40, partitions=3)
    assert model["subjects"] == ["law", "sport"]
    got = {}
    for r in sub.subject_areas(docs, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert r.sentences >= 2
    right = sum(got.get(1000 + i, set()) == set(a) for i, _, a in held)
    assert right >= 0.95 * len(held)
    assert not {5000, 5001, 5002} & set(got)
    one = sub.fit(docs, labels, steps=40, partitions=1)
    assert np.abs(one["b"] - model["b"]).max() < 0.05  # the sum does not depend on the partitions
    c = {r.subject: r.documents for r in sub.composition(sub.subject_areas(docs, model), docs).collect()}
    assert c["none"] == 503 - len(got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    model = sub.fit(docs, none)
    assert model["subjects"] == [] and sub.subject_areas(docs, model).count() == 0
    assert sub.subject_areas(docs.limit(0), sub.new_model(["law"])).count() == 0
