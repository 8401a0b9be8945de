"""Samples whose category shares match target proportions.

The targets of a plan form a two-way table (subtype x answer type) of fractional row
quotas with target margins.  Where a cell has fewer rows than it wants, or a floor asks for
more than its share, the table is fitted again to both margins: a flow through the cells,
bounded below by the floors and above by what exists, that leaves the wanted quotas as
little as possible.  Controlled rounding then makes it integer by max-flow, each cell, each
margin and the total going to the integer below or above.  Each cell gives exactly its quota
of rows with the smallest random keys: histograms of key buckets, the second one only of
the boundary bucket, find the boundary, rows below it are taken by a filter, and only rows
of the last boundary bucket are ranked.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import category
from ledgerloom.session import cut, small

#: Bits of the random key per level of buckets, and levels.
BITS, LEVELS = 14, 2
#: Quotas are fitted in units of so many to a row.
UNIT = 1_000_000
#: Cells are let above what they want step by step, so that what others lack spreads over them.
STEPS = (1.0, 1.02, 1.05, 1.1, 1.2, 1.5, 2.0, 4.0, math.inf)


class _Flow:
    """Max-flow by shortest augmenting paths (breadth-first, integer capacities)."""

    def __init__(self) -> None:
        self.cap: dict[tuple, int] = defaultdict(int)
        self.near: dict[object, list] = defaultdict(list)

    def edge(self, u, v, cap: int) -> None:
        if (u, v) not in self.cap and (v, u) not in self.cap:
            self.near[u].append(v)
            self.near[v].append(u)
        self.cap[u, v] += cap
        self.cap[v, u] += 0

    def run(self, s, t) -> int:
        total = 0
        while True:
            back = {s: s}
            queue = deque([s])
            while queue and t not in back:
                u = queue.popleft()
                for v in self.near[u]:
                    if v not in back and self.cap[u, v] > 0:
                        back[v] = u
                        queue.append(v)
            if t not in back:
                return total
            path = [t]
            while path[-1] != s:
                path.append(back[path[-1]])
            steps = list(zip(path[1:], path[:-1]))
            push = min(self.cap[e] for e in steps)
            for u, v in steps:
                self.cap[u, v] -= push
                self.cap[v, u] += push
            total += push


def controlled_rounding(quotas: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """Integer quotas of a two-way table: cells, row sums, column sums and total each rounded down or up.

    Such a table always exists (the fractional one is a feasible flow between the
    same bounds).  The total is rounded to the nearest integer.  Whole quotas stay.
    """
    q = {c: round(v, 9) for c, v in quotas.items()}
    rows, cols = defaultdict(float), defaultdict(float)
    for (r, c), v in q.items():
        rows[r] += v
        cols[c] += v
    total = round(sum(q.values()), 6)
    bounds = lambda v: (math.floor(round(v, 6)), math.ceil(round(v, 6)))
    low: dict[tuple, tuple[int, int]] = {}
    for r, v in rows.items():
        low["source", ("row", r)] = bounds(v)
    for c, v in cols.items():
        low[("col", c), "sink"] = bounds(v)
    for (r, c), v in q.items():
        low[("row", r), ("col", c)] = bounds(v)
    whole = math.floor(total + 0.5)
    flow = _Flow()
    need = 0
    excess: dict[object, int] = defaultdict(int)
    for (u, v), (lo, hi) in low.items():
        flow.edge(u, v, hi - lo)
        excess[v] += lo
        excess[u] -= lo
    excess["source"] += whole
    excess["sink"] -= whole
    for node, x in excess.items():
        if x > 0:
            flow.edge("from", node, x)
            need += x
        elif x < 0:
            flow.edge(node, "to", -x)
    if flow.run("from", "to") != need:
        raise ValueError("the quotas admit no controlled rounding")
    return {(r, c): low[("row", r), ("col", c)][0] + flow.cap[("col", c), ("row", r)] for (r, c) in q}


Cell = tuple[str, str]


def fit_quotas(
    target: Mapping[Cell, float], floor: Mapping[Cell, float], available: Mapping[Cell, float], overfill: bool = True
) -> dict[Cell, float]:
    """Fractional quotas between floor and available rows whose margins are those of ``target`` (rows per cell).

    A floor beyond what exists is what exists.  Floors that add up to more than a margin
    raise it.  Where the rows that exist cannot fill both margins, the quotas fill as much of
    both as any table can; with ``overfill`` what is missing then comes from other categories
    of the second margin, so that the first one holds, and last from others of the first,
    so that the size holds.
    """
    low = {c: int(min(floor[c], available[c]) * UNIT) for c in target}
    most = {c: int(available[c] * UNIT) for c in target}
    asked = {c: int(round(target[c] * UNIT)) for c in target}
    want = {c: max(asked[c], low[c]) for c in target}
    flow = _Flow()
    sides: list[dict[str, int]] = []
    for axis in (0, 1):
        side, base = defaultdict(int), defaultdict(int)
        for c in target:
            side[c[axis]] += asked[c]
            base[c[axis]] += low[c]
        sides.append(side)
        for k in side:
            flow.edge(*(("all", ("row", k)) if axis == 0 else (("col", k), "sink")), max(side[k] - base[k], 0))
    flow.edge("source", "all", max(sum(asked.values()) - sum(low.values()), 0))
    given = dict.fromkeys(target, 0)
    for step in STEPS:
        for c in target:
            cap = most[c] if math.isinf(step) else min(int(want[c] * step), most[c])
            more = cap - low[c] - given[c]
            if more > 0:
                flow.edge(("row", c[0]), ("col", c[1]), more)
                given[c] += more
        flow.run("source", "sink")
    everything = sum(most.values())
    for axis, side in ((1, sides[1]), (0, sides[0])) if overfill else ():
        before = 1.0
        for step in STEPS[1:]:
            for k, rows in side.items():
                more = everything if math.isinf(step) else int(rows * (step - before))
                flow.edge(*(("all", ("row", k)) if axis == 0 else (("col", k), "sink")), more)
            before = step
            flow.run("source", "sink")
    return {c: (low[c] + flow.cap[("col", c[1]), ("row", c[0])]) / UNIT for c in target}


_PLAN = (
    "plan_id long, subtype string, answer_type string, cell_a string, cell_b string, target_share double, wanted double, "
    "available long, fitted double, quota long, short boolean"
)


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["cell_a", "cell_b"], kind="stable").reset_index(drop=True)
    cells = list(zip(pdf["cell_a"], pdf["cell_b"]))
    target = dict(zip(cells, pdf["target"].astype(float)))
    floor = dict(zip(cells, pdf["floor_rows"].astype(float)))
    available = dict(zip(cells, pdf["rows"].astype(float)))
    fitted = fit_quotas(target, floor, available)
    quota = controlled_rounding(fitted)
    wanted = [max(floor[c], round(target[c], 9)) for c in cells]
    return pd.DataFrame(
        {
            "plan_id": pdf["plan_id"],
            "subtype": pdf["subtype"],
            "answer_type": pdf["answer_type"],
            "cell_a": pdf["cell_a"],
            "cell_b": pdf["cell_b"],
            "target_share": pdf["target_share"],
            "wanted": wanted,
            "available": pdf["rows"],
            "fitted": [fitted[c] for c in cells],
            "quota": [quota[c] for c in cells],
            "short": [available[c] < w for c, w in zip(cells, wanted)],
        }
    )


def plan_quotas(targets: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """One row per category of a plan: wanted, available, fitted and granted rows, and whether it falls short.

    ``targets`` has the columns of sampling_targets; ``counts`` (cell_a, cell_b, rows)
    the rows by canonical category; ``total`` the number of all rows.  A category
    wants the larger of its floor and its share of the sample; where fewer rows exist it
    is reported, and the others are fitted to the target margins.  Targets with a null
    label, plan or share are ignored; repeated targets of a category add up.  Each plan is
    fitted in one task of its own.
    """
    named = targets.where("plan_id is not null and target_share is not null and sample_frac is not null").select(
        F.col("plan_id").cast("long").alias("plan_id"),
        "subtype",
        "answer_type",
        category(F.col("subtype")).alias("cell_a"),
        category(F.col("answer_type")).alias("cell_b"),
        "target_share",
        F.coalesce("floor_rows", F.lit(0)).alias("floor_rows"),
        "sample_frac",
    )
    named = (
        named.where("cell_a is not null and cell_b is not null")
        .groupBy("plan_id", "cell_a", "cell_b")
        .agg(
            F.min("subtype").alias("subtype"),
            F.min("answer_type").alias("answer_type"),
            F.sum("target_share").alias("target_share"),
            F.max("floor_rows").alias("floor_rows"),
            F.max("sample_frac").alias("sample_frac"),
        )
    )
    joined = named.join(small(counts), ["cell_a", "cell_b"], "left").fillna({"rows": 0})
    return joined.withColumn("target", F.col("target_share") * F.col("sample_frac") * F.lit(float(total))).groupBy("plan_id").applyInPandas(_plan, _PLAN)


def margin_report(report: DataFrame) -> DataFrame:
    """Per plan, margin and category: the share wanted, the rows granted and their share of the sample."""
    sides = F.array(
        F.struct(F.lit("subtype").alias("margin"), F.col("cell_a").alias("category")),
        F.struct(F.lit("answer_type").alias("margin"), F.col("cell_b").alias("category")),
    )
    by = (
        report.select("plan_id", "target_share", "quota", F.explode(sides).alias("m"))
        .groupBy("plan_id", "m.margin", "m.category")
        .agg(F.sum("target_share").alias("target_share"), F.sum("quota").alias("granted"))
    )
    of_plan = F.sum("granted").over(Window.partitionBy("plan_id", "margin"))
    return by.withColumn("actual_share", F.col("granted") / F.nullif(of_plan, F.lit(0)))


def quota_sample(rows: DataFrame, quotas: DataFrame, key: str = "row_id", seed: int = 13, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(plan_id, key, cell_a, cell_b): exactly ``quota`` rows of each category of each plan.

    ``rows`` has the key and the canonical categories cell_a, cell_b; rows with a null
    category are never drawn.  The order within a cell is that of a hash of plan,
    seed and key; equal hashes are ordered by key.  Rows with equal keys are told
    apart by nothing and may both be drawn.
    """
    cell = ["plan_id", "cell_a", "cell_b"]
    plan = small(quotas.where("quota > 0").select(*cell, "quota"))
    keyed = (
        rows.where("cell_a is not null and cell_b is not null")
        .join(plan, ["cell_a", "cell_b"])
        .withColumn("rank_key", F.shiftrightunsigned(F.xxhash64("plan_id", F.lit(seed), key), 1))
    )
    # prefix and rest of each cell: rows below the prefix are in, ``rest`` more come out of the bucket of the prefix
    edge = plan.select(*cell, F.col("quota").alias("rest"), F.lit(0).cast("long").alias("edge"))
    upto = Window.partitionBy(*cell).orderBy("bucket")
    for level in range(1, levels + 1):
        at = F.shiftright("rank_key", 63 - bits * level)
        here = keyed.select(*cell, at.alias("bucket"))
        if level > 1:
            inside = edge.select(*cell, "edge")
            here = here.join(F.broadcast(inside), cell).where(F.shiftright("bucket", bits) == F.col("edge")).drop("edge")
        hist = here.groupBy(*cell, "bucket").agg(F.count("*").alias("n"))
        placed = hist.withColumn("before", F.sum("n").over(upto) - F.col("n")).join(F.broadcast(edge.select(*cell, "rest")), cell)
        # as many rows as the plans have cells
        edge = cut(
            placed.where("before < rest and before + n >= rest").select(*cell, (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("edge"))
        )
    last = F.shiftright("rank_key", 63 - bits * levels)
    placed = keyed.join(F.broadcast(edge), cell, "left")
    inside = placed.where(F.col("edge").isNull() | (last < F.col("edge")))
    w = Window.partitionBy(*cell).orderBy("rank_key", key)
    ranked = placed.where(last == F.col("edge")).withColumn("r", F.row_number().over(w)).where("r <= rest")
    out = [*cell[:1], key, *cell[1:]]
    return inside.select(*out).union(ranked.select(*out))


def sample_to_targets(records: DataFrame, targets: DataFrame, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of ``records`` for every plan of ``targets``.

    The report has the columns of :func:`plan_quotas`.  An empty table of records
    leaves every category with a positive target short and gives an empty sample.
    """
    rows = records.select(
        "row_id",
        category(F.col("subtype")).alias("cell_a"),
        category(F.col("answer_type")).alias("cell_b"),
    )
    counts = cut(rows.groupBy("cell_a", "cell_b").agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    report = cut(plan_quotas(targets, counts.where("cell_a is not null and cell_b is not null"), total))
    return quota_sample(rows, report, seed=seed), report
