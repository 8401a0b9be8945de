"""Train/validation/test splits that keep related records together.

Records are linked to issuers, issuers to each other (former codes, records that
name two issuers); connected components never cross a split.  Components are
packed into many nearly equal bins by k-way largest differencing, which works on
tuples of bin loads and is therefore applied level by level: groups of components
are differenced independently in parallel, the resulting bins are the items of
the next level, until one group is left.  Only its bins reach the driver, where
whole bins are given to splits so that sizes and category shares fit.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import category, issuer_code
from ledgerloom.session import cut, small

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Bins of the last level; a bin is the smallest piece that a split can get beyond one component.
BINS = 100
#: Items that one task differences at a time.
GROUP_ITEMS = 20_000
#: Categories whose shares are balanced one by one, the most frequent ones.
CATEGORIES = 1000


def resolve_issuers(rows: DataFrame, issuers: DataFrame) -> DataFrame:
    """``rows`` (row_id, filename, id) with ``entity`` and ``linked`` (the issuer of the id, where it differs).

    The path in ``filename`` decides, else the one in ``id``; former codes become
    current ones.  A code unknown to ``issuers`` stands for itself; a row without
    any code has a null entity.  Null and repeated codes in ``issuers`` are ignored.
    """
    codes = issuers.select(F.upper(F.trim("issuer_code")).alias("code"), F.upper(F.trim("former_code")).alias("former"))
    known = codes.where("code is not null").select("code").distinct()
    current = (
        codes.where("code is not null and former is not null")
        .groupBy("former")
        .agg(F.min("code").alias("current"))
        .join(known.withColumnRenamed("code", "former"), "former", "left_anti")
    )
    current = small(current)
    named = rows.select("row_id", "category", issuer_code(F.col("filename")).alias("a"), issuer_code(F.col("id")).alias("b"))
    for c in ("a", "b"):
        named = named.join(current.withColumnsRenamed({"former": c, "current": f"{c}_now"}), c, "left").withColumn(
            c, F.coalesce(f"{c}_now", c)
        )
    return named.select(
        "row_id",
        "category",
        F.coalesce("a", "b").alias("entity"),
        F.when(F.col("a") != F.col("b"), F.col("b")).alias("linked"),
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph ``edges`` (a, b); a component is named by its smallest node.

    Alternates large-star and small-star steps, each one shuffle with pre-aggregated
    minima, until no edge changes; the lineage is cut after every round.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        joined = down.join(low, "a")
        step = (
            joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .union(low.select("a", F.col("low").alias("b")))
            .distinct()
        )
        e = cut(step)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = tuple(now)


def difference_bins(weights: Sequence[float], k: int) -> np.ndarray:
    """Bin (0..k-1) of each weight by k-way largest differencing.

    Each item starts as a tuple of one loaded and k-1 empty bins.  The two tuples
    with the largest spread are combined again and again, the heaviest bin of one
    with the lightest of the other.  Ties go by position; no weights give no bins.
    """
    n = len(weights)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    parent: list[int] = [-1] * n
    loads = {i: (np.array([float(weights[i])]), [i]) for i in range(n)}
    heap = [(-float(weights[i]), i, i) for i in range(n)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        (lx, nx), (ly, ny) = loads.pop(x), loads.pop(y)
        # bins are kept in descending order and empty ones left out
        sums: list[tuple[float, int]] = []
        at = list(range(len(nx)))
        for j, node in enumerate(ny):
            i = k - 1 - j
            if i < len(nx):
                new = len(parent)
                parent.append(-1)
                parent[nx[i]] = parent[node] = new
                sums.append((lx[i] + ly[j], new))
                at[i] = -1
            else:
                sums.append((ly[j], node))
        sums += [(lx[i], nx[i]) for i in at if i >= 0]
        sums.sort(key=lambda s: (-s[0], s[1]))
        load = np.array([s[0] for s in sums])
        low = load[-1] if len(load) == k else 0.0
        loads[serial] = (load, [s[1] for s in sums])
        heapq.heappush(heap, (low - load[0], serial, serial))
        serial += 1
    _, tops = next(iter(loads.values()))
    place = [-1] * len(parent)
    for b, node in enumerate(tops):
        place[node] = b
    for node in range(len(parent) - 1, -1, -1):
        if place[node] < 0:
            place[node] = place[parent[node]]
    return np.array(place[:n], dtype=np.int64)


def allocate(loads: np.ndarray, targets: Sequence[float]) -> np.ndarray:
    """Split (position in ``targets``) of each bin.

    ``loads`` has a row per bin: its records per category.  Bins are placed from the
    heaviest on and then moved and swapped while that lowers the squared distance of
    sizes (weight 1 on the share of all rows) and of category counts from target.
    """
    n, s = len(loads), len(targets)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    total = loads.sum()
    scale = max(total, 1.0)
    features = np.column_stack([loads.sum(axis=1) * 2.0, loads]) / scale
    goal = np.outer(np.asarray(targets, dtype=float), features.sum(axis=0))
    have = np.zeros_like(goal)
    where = np.zeros(n, dtype=np.int64)
    for b in np.argsort(-features[:, 0], kind="stable"):
        cost = [((have + np.eye(s)[j][:, None] * features[b] - goal) ** 2).sum() for j in range(s)]
        where[b] = int(np.argmin(cost))
        have[where[b]] += features[b]
    for _ in range(20 * n):
        err = have - goal
        best = (-1e-15, None)
        for p in range(s):
            mine = np.flatnonzero(where == p)
            if not len(mine):
                continue
            for q in range(s):
                if p == q:
                    continue
                theirs = np.flatnonzero(where == q)
                d = features[mine]
                moves = ((err[p] - d) ** 2 + (err[q] + d) ** 2).sum(axis=1) - (err[p] ** 2 + err[q] ** 2).sum()
                i = int(np.argmin(moves))
                if moves[i] < best[0]:
                    best = (float(moves[i]), (p, q, mine[i], None))
                if p < q and len(theirs):
                    d = features[mine][:, None, :] - features[theirs][None, :, :]
                    swaps = ((err[p] - d) ** 2 + (err[q] + d) ** 2).sum(axis=2) - (err[p] ** 2 + err[q] ** 2).sum()
                    i, j = np.unravel_index(int(np.argmin(swaps)), swaps.shape)
                    if swaps[i, j] < best[0]:
                        best = (float(swaps[i, j]), (p, q, mine[i], theirs[j]))
        if best[1] is None:
            break
        p, q, i, j = best[1]
        d = features[i] - (features[j] if j is not None else 0)
        have[p] -= d
        have[q] += d
        where[i] = q
        if j is not None:
            where[j] = p
    return where


def _bin_groups(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rows", "item"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"item": pdf["item"], "grp": pdf["grp"], "bin": difference_bins(pdf["rows"].to_numpy(), k)})

    return run


def _level(items: DataFrame, k: int, groups: int) -> DataFrame:
    """(item, parent): each item's bin, named by group and bin."""
    grouped = items.select("item", "rows", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("long").alias("grp"))
    placed = grouped.groupBy("grp").applyInPandas(_bin_groups(k), "item string, grp long, bin long")
    return placed.select("item", F.concat_ws(":", "grp", "bin").alias("parent"))


def balanced_splits(
    weights: DataFrame, ratios: Mapping[str, float] = RATIOS, k: int = BINS, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """(component, split) for ``weights`` (component STRING, category STRING, rows BIGINT).

    The last level has at most ``group_items`` items in one task; each level divides
    their number by ``group_items / k``, so ``group_items`` is at least twice ``k``.
    """
    group_items = max(group_items, 2 * k)
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    weights = cut(weights)
    items = weights.groupBy(F.col("component").alias("item")).agg(F.sum("rows").alias("rows"))
    path = items.select(F.col("item").alias("component"), F.col("item").alias("parent"))
    n = items.count()
    while True:
        groups = max(1, -(-n // group_items))
        level = cut(_level(items, k, groups))
        up = level.select(F.col("item").alias("parent"), F.col("parent").alias("up"))
        path = path.join(up, "parent").select("component", F.col("up").alias("parent"))
        if groups == 1:
            break
        items = items.join(level, "item").groupBy(F.col("parent").alias("item")).agg(F.sum("rows").alias("rows"))
        n = items.count()
    path = cut(path)
    # rare categories are balanced together, so that bins times categories stay few
    often = weights.groupBy("category").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "category").limit(CATEGORIES)
    named = weights.join(F.broadcast(often.select("category", F.col("category").alias("named"))), "category", "left")
    named = named.withColumn("category", F.coalesce("named", F.lit("(rare)")))
    loads = named.join(path, "component").groupBy("parent", "category").agg(F.sum("rows").alias("rows")).toPandas()
    wide = loads.pivot_table(index="parent", columns="category", values="rows", aggfunc="sum", fill_value=0, dropna=False)
    wide = wide.sort_index()
    names = list(ratios)
    chosen = allocate(wide.to_numpy(dtype=float), [ratios[x] for x in names])
    spark = weights.sparkSession
    of_bin = spark.createDataFrame([(b, names[j]) for b, j in zip(wide.index, chosen)], "parent string, split string")
    return path.join(F.broadcast(of_bin), "parent").select("component", "split")


def split_records(
    records: DataFrame,
    issuers: DataFrame,
    ratios: Mapping[str, float] = RATIOS,
    k: int = BINS,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """(row_id, entity, component, category, split): one row for each record, no component in two splits.

    Rows without any issuer are components of their own.  Null categories form a
    category.  Repeated rows count like any others.  An empty table gives an empty result.
    """
    rows = records.select(
        "row_id",
        F.when(F.trim(F.col("metadata.filename")) != "", F.col("metadata.filename")).alias("filename"),
        "id",
        F.coalesce(category(F.col("subtype")), F.lit("(none)")).alias("category"),
    )
    rows = cut(resolve_issuers(rows, issuers))
    edges = rows.where("linked is not null").select(F.col("entity").alias("a"), F.col("linked").alias("b")).distinct()
    own = F.coalesce(F.col("entity"), F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    if edges.isEmpty():
        rows = rows.withColumn("component", own)
    else:
        linked = small(components(edges).withColumnRenamed("node", "entity"))
        rows = rows.join(linked, "entity", "left").withColumn("component", F.coalesce("component", own))
    weights = rows.groupBy("component", "category").agg(F.count("*").alias("rows"))
    splits = small(balanced_splits(weights, ratios, k, group_items))
    return rows.join(splits, "component").select("row_id", "entity", "component", "category", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Rows, issuers and shares per split and category, with the share of the category in all rows."""
    by = assigned.groupBy("split", "category").agg(F.count("*").alias("rows"), F.countDistinct("component").alias("components"))
    in_split = by.groupBy("split").agg(F.sum("rows").alias("split_rows"))
    in_cat = by.groupBy("category").agg(F.sum("rows").alias("category_rows"))
    total = by.agg(F.sum("rows").alias("all_rows"))
    return (
        by.join(F.broadcast(in_split), "split")
        .join(F.broadcast(in_cat), "category")
        .crossJoin(F.broadcast(total))
        .select(
            "split",
            "category",
            "rows",
            "components",
            F.round(F.col("split_rows") / F.col("all_rows"), 6).alias("split_share"),
            F.round(F.col("rows") / F.col("split_rows"), 6).alias("category_share"),
            F.round(F.col("category_rows") / F.col("all_rows"), 6).alias("target_share"),
        )
    )
