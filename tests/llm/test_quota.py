import math
import random
from collections import Counter, defaultdict

from ledgerloom.llm import quota

ROWS = "row_id long, subtype string, answer_type string, bucket long, cell_a string, quota long"
TARGETS = "plan_id int, subtype string, answer_type string, target_share double, floor_rows int, sample_frac double"


def test_controlled_rounding():
    rng = random.Random(1)
    for _ in range(60):
        q = {(f"r{rng.randint(0, 4)}", f"c{rng.randint(0, 4)}"): rng.choice([rng.random() * 9, float(rng.randint(0, 5))]) for _ in range(rng.randint(1, 14))}
        got = quota.controlled_rounding(q)
        assert all(math.floor(v + 1e-9) <= got[c] <= math.ceil(v - 1e-9) for c, v in q.items())
        for axis in (0, 1):
            real, whole = defaultdict(float), defaultdict(int)
            for c in q:
                real[c[axis]] += q[c]
                whole[c[axis]] += got[c]
            assert all(math.floor(real[k] + 1e-6) <= whole[k] <= math.ceil(real[k] - 1e-6) for k in real)
        assert sum(got.values()) == math.floor(sum(q.values()) + 0.5 + 1e-6)
    assert quota.controlled_rounding({}) == {}


def make(spark, n=600):
    rng = random.Random(4)
    kinds = ["ratio", "Ratio ", "RATIO", "look-up", "lookup", "multi_step", "Multi Step", None]
    types = ["percent", "%", "pct", "money", "currency", None, "num"]
    rows = [(i, "ratio" if rng.random() < 0.35 else rng.choice(kinds), rng.choice(types), 0, "clash", 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, ROWS)


def canon(s, t):
    k = None if s is None else s.lower().replace("-", "").replace("_", "").replace(" ", "")
    v = None if t is None else {"%": "percent", "pct": "percent", "money": "currency", "num": "number"}.get(t, t)
    return k, v


def test_sample_and_report(spark):
    rows, df = make(spark)
    targets = [(1, "ratio", "percent", 0.5, 3, 0.2), (1, "lookup", "currency", 0.3, 3, 0.2), (1, "multi_step", "text", 0.2, 3, 0.2),
               (2, "lookup", "number", 0.0, 10, 0.1), (2, "ratio", "percent", 1.0, 0, 0.9), (None, "ratio", "percent", 1.0, 0, 0.9), (3, None, "percent", 1.0, 1, 0.9)]
    sample, report = quota.sample_to_targets(df, spark.createDataFrame(targets, TARGETS))
    counts = Counter(canon(r[1], r[2]) for r in rows)
    got = {(r.plan_id, r.subtype, r.answer_type): r for r in report.collect()}
    assert set(got) == {t[:3] for t in targets if t[0] and t[1]}
    for (plan, s, t), r in got.items():
        share, floor, frac = next(x[3:] for x in targets if x[:3] == (plan, s, t))
        want = max(floor, share * frac * len(rows))
        have = counts[canon(s, t)]
        assert (r.available, r.short) == (have, have < round(want, 9))
        assert min(floor, have) <= r.quota <= have
    picked = sample.collect()
    assert len({(r.plan_id, r.row_id) for r in picked}) == len(picked)
    by = Counter((r.plan_id, r.cell_a, r.cell_b) for r in picked)
    for r in got.values():
        assert by[r.plan_id, r.cell_a, r.cell_b] == r.quota
    again = quota.sample_to_targets(df, spark.createDataFrame(targets, TARGETS))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, picked))


def best_fill(share, size, low, available):
    """The most rows that any table within the margins and bounds can have, by linear programming over vertices of cuts."""
    cells = list(share)
    rows, cols = {c[0] for c in cells}, {c[1] for c in cells}
    side = lambda axis, k: max(sum(share[c] for c in cells if c[axis] == k) * size, sum(low[c] for c in cells if c[axis] == k))
    best = math.inf
    for m in range(1 << len(rows)):
        inside = {r for i, r in enumerate(sorted(rows)) if m >> i & 1}
        for n in range(1 << len(cols)):
            behind = {c for i, c in enumerate(sorted(cols)) if n >> i & 1}
            # a cut: rows left of it, columns left of it
            cost = sum(side(0, r) - sum(low[c] for c in cells if c[0] == r) for r in rows - inside)
            cost += sum(side(1, k) - sum(low[c] for c in cells if c[1] == k) for k in behind)
            cost += sum(available[c] - low[c] for c in cells if c[0] in inside and c[1] not in behind)
            best = min(best, cost)
    return best + sum(low.values())


def test_fit_keeps_the_margins_where_the_pool_allows():
    rng = random.Random(3)
    exact = 0
    for _ in range(150):
        cells = sorted({(f"r{rng.randint(0, 2)}", f"c{rng.randint(0, 3)}") for _ in range(rng.randint(2, 12))})
        share = {c: rng.random() for c in cells}
        share = {c: v / sum(share.values()) for c, v in share.items()}
        size = rng.choice([40, 300])
        available = {c: rng.choice([0, int(share[c] * size * 0.7), *[size] * 12]) for c in cells}
        floor = {c: rng.choice([0, 0, 2, 5]) for c in cells}
        low = {c: min(floor[c], available[c]) for c in cells}
        target = {c: v * size for c, v in share.items()}
        got = quota.fit_quotas(target, floor, available, overfill=False)
        assert all(low[c] - 1e-6 <= got[c] <= available[c] + 1e-6 for c in cells)
        assert abs(sum(got.values()) - min(best_fill(share, size, low, available), max(size, sum(low.values())))) < 0.01
        full = quota.fit_quotas(target, floor, available)
        assert abs(sum(full.values()) - min(max(size, sum(low.values())), sum(available.values()))) < 0.01
        if not any(low.values()):  # each category of the first margin has what exists of it
            for k in {c[0] for c in cells}:
                want, exist = (sum(x[c] for c in cells if c[0] == k) for x in (target, available))
                assert sum(full[c] for c in cells if c[0] == k) >= min(want, exist) - 0.01
        for fitted in (got, full):
            whole = quota.controlled_rounding(fitted)
            assert all(low[c] <= whole[c] <= available[c] for c in cells)
        whole = quota.controlled_rounding(got)
        sides = [(axis, k, sum(target[c] for c in cells if c[axis] == k)) for axis in (0, 1) for k in {c[axis] for c in cells}]
        floors_fit = all(sum(low[c] for c in cells if c[axis] == k) <= want for axis, k, want in sides)
        if floors_fit and abs(sum(got.values()) - size) < 0.001:  # then both margins hold, to within one row
            exact += 1
            assert all(abs(sum(whole[c] for c in cells if c[axis] == k) - want) < 1 + 1e-3 for axis, k, want in sides)
        if all(available[c] >= share[c] * size >= floor[c] for c in cells):
            assert all(abs(got[c] - share[c] * size) < 0.001 for c in cells)
    assert exact > 30


def test_margins_are_fitted_around_a_short_cell(spark):
    targets = [(1, "ratio", "percent", 0.4, 0, 0.5), (1, "ratio", "number", 0.2, 0, 0.5), (1, "lookup", "percent", 0.2, 0, 0.5), (1, "lookup", "number", 0.2, 0, 0.5)]
    pool = [("ratio", "percent", 20), ("ratio", "number", 60), ("lookup", "percent", 60), ("lookup", "number", 60)]
    rows = [(i, s, t, 0, "x", 0) for i, (s, t) in enumerate((s, t) for s, t, n in pool for _ in range(n))]
    sample, report = quota.sample_to_targets(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS))
    got = {(r.subtype, r.answer_type): (r.quota, r.short) for r in report.collect()}
    assert got == {("ratio", "percent"): (20, True), ("ratio", "number"): (40, False), ("lookup", "percent"): (40, False), ("lookup", "number"): (0, False)}
    margins = {(r.margin, r.category): (r.granted, round(r.actual_share, 6)) for r in quota.margin_report(report).collect()}
    assert margins == {("subtype", "ratio"): (60, 0.6), ("subtype", "lookup"): (40, 0.4), ("answer_type", "percent"): (60, 0.6), ("answer_type", "number"): (40, 0.4)}
    assert sample.count() == 100


def test_sample_is_the_smallest_keys(spark):
    _, df = make(spark)
    rows = df.selectExpr("row_id", "'a' as cell_a", "'b' as cell_b")
    q = spark.createDataFrame([(1, "a", "b", 37)], "plan_id long, cell_a string, cell_b string, quota long")
    keys = rows.selectExpr("row_id", "shiftrightunsigned(xxhash64(1L, 13, row_id), 1) as k").collect()
    want = {r.row_id for r in sorted(keys, key=lambda r: (r.k, r.row_id))[:37]}
    for bits, levels in ((14, 2), (2, 1), (1, 3), (3, 2)):
        assert {r.row_id for r in quota.quota_sample(rows, q, bits=bits, levels=levels).collect()} == want


def test_edges(spark):
    targets = spark.createDataFrame([(1, "ratio", "percent", 1.0, 2, 0.5)], TARGETS)
    sample, report = quota.sample_to_targets(spark.createDataFrame([], ROWS), targets)
    assert sample.count() == 0 and report.first().short
    _, df = make(spark, 50)
    sample, report = quota.sample_to_targets(df, targets.limit(0))
    assert sample.count() == 0 and report.count() == 0
