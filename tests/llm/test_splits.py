import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import splits

SCHEMA = "row_id long, id string, subtype string, metadata struct<filename: string>, entity string, component string, bin long"
ISSUERS = "issuer_code string, former_code string"


def brute_bins(weights, k):
    """Differencing with full tuples."""
    items = [([w] + [0.0] * (k - 1), [[i]] + [[] for _ in range(k - 1)], i) for i, w in enumerate(weights)]
    serial = len(items)
    while len(items) > 1:
        items.sort(key=lambda t: (-(max(t[0]) - min(t[0])), t[2]))
        (la, ma, _), (lb, mb, _) = items.pop(0), items.pop(0)
        pairs = sorted(((la[i] + lb[k - 1 - i], ma[i] + mb[k - 1 - i]) for i in range(k)), key=lambda p: -p[0])
        items.append(([p[0] for p in pairs], [p[1] for p in pairs], serial))
        serial += 1
    return sorted(items[0][0], reverse=True)


def test_differencing_against_brute_force():
    rng = random.Random(1)
    for k in (2, 3, 7):
        for n in (1, 2, 5, 30):
            w = [rng.randint(1, 50) for _ in range(n)]
            bins = splits.difference_bins(w, k)
            loads = np.bincount(bins, weights=w, minlength=k)
            assert sorted(loads, reverse=True) == pytest.approx(brute_bins(w, k))
    assert len(splits.difference_bins([], 3)) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]  # a long chain
    got = {r.node: r.component for r in splits.components(spark.createDataFrame(edges + [(None, "x")], "a string, b string")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def records(n=900, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = "BIG" if rng.random() < 0.34 else f"{rng.choice('ABCDEFGH')}{rng.choice('KLMN')}{rng.choice('XYZ')}"
        name = None if rng.random() < 0.2 else rng.choice([f"{code}/2014/page_1.pdf", f"{code.lower()}-2014-page_1.pdf", f"./raw/{code}/2014/page_2.pdf"])
        ident = f"rec{i}" if name and rng.random() < 0.3 else f"{code}/2014/page_1.pdf-{i}"
        out.append((i, ident, rng.choice(["ratio", "Ratio ", "lookup", None]), (name,), "clash", "clash", 0))
    return out


def test_no_component_is_split(spark):
    rows = records()
    rows.append((10_000, "OLD/2014/page_1.pdf-1", "ratio", ("AKX/2014/page_1.pdf",), None, None, None))  # links two issuers
    rows.append((10_001, None, None, None, None, None, None))
    rows.append((10_002, "LATE/2014/page_1.pdf-1", None, (" ",), None, None, None))
    rows += rows[:5]
    issuers = spark.createDataFrame([("NEW", "LATE"), ("AKX", None), (None, "Q"), ("NEW", "LATE")], ISSUERS)
    got = splits.split_records(spark.createDataFrame(rows, SCHEMA), issuers, k=40, group_items=20).collect()
    assert len(got) == len(rows)
    where = defaultdict(set)
    for r in got:
        where[r.component].add(r.split)
    assert all(len(s) == 1 for s in where.values())
    by = {r.row_id: r for r in got}
    assert by[10_000].entity == "AKX" and by[10_001].entity is None and by[10_002].entity == "NEW"
    assert len({r.component for r in got if r.entity in ("AKX", "OLD")}) == 1
    shares = Counter(r.split for r in got)
    for name, want in splits.RATIOS.items():
        assert abs(shares[name] / len(got) - want) < 0.03
    again = splits.split_records(spark.createDataFrame(rows, SCHEMA), issuers, k=40, group_items=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_edges(spark):
    issuers = spark.createDataFrame([], ISSUERS)
    assert splits.split_records(spark.createDataFrame([], SCHEMA), issuers).count() == 0
    one = splits.split_records(spark.createDataFrame(records(1), SCHEMA), issuers).collect()
    assert [r.split for r in one] == ["train"]
    with pytest.raises(ValueError):
        splits.balanced_splits(spark.createDataFrame([], "component string, category string, rows long"), {"a": 0.4})
    report = splits.split_report(splits.split_records(spark.createDataFrame(records(60), SCHEMA), issuers))
    assert sum(r.rows for r in report.collect()) == 60
