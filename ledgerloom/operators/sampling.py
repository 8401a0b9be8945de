"""Stratified splits, quota samples and greedy bucket samples with reproducible random order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import label_by_rank, random_key
from ledgerloom.session import cut, small

# Default ratios and mixes.
SPLIT_RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
CALCULATION_MIX = {"ratio": 300, "arithmetic": 150, "multi_step": 50}
REASONING_MIX = {"ratio": 600, "arithmetic": 300, "multi_step": 100}
PROGRAM_MIX = {"ratio": 550, "arithmetic": 300, "multi_step": 100, "lookup": 50}
TARGETED_MIX = {
    "table_aggregation": 120,
    "sign_direction": 250,
    "unit_scale": 350,
    "percent_change_template": 550,
    "multi_step_program": 350,
    "source_number_selection": 380,
}
SOURCE_MIX = {
    "source_number_selection": 500,
    "percent_change_template": 450,
    "unit_scale": 350,
    "table_aggregation": 250,
    "sign_direction": 250,
    "multi_step_program": 200,
}


class ShortfallError(ValueError):
    """A strict sample found fewer rows than asked for."""


def stratified_split(
    rows: DataFrame, stratum: str, key: str, ratios: Mapping[str, float] = SPLIT_RATIOS, seed: int = 13, out: str = "split"
) -> DataFrame:
    """``rows`` with their split: within each stratum ``floor(n * ratio)`` rows per split in order, the rest to the last."""
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    keyed = rows.withColumn("_key", random_key(seed, key))
    names = list(ratios)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    size = lambda r: F.floor(F.col("n").cast("double") * F.lit(float(r)))
    upto: list[Column] = []
    for name in names[:-1]:
        upto.append(size(ratios[name]) + (upto[-1] if upto else F.lit(0)))
    upto.append(F.col("n"))
    marks = F.array(*[F.struct(u.cast("long").alias("upto"), F.lit(x).alias(out)) for u, x in zip(upto, names)])
    bounds = sizes.select(stratum, F.explode(marks).alias("m")).select(stratum, "m.upto", f"m.{out}")
    # an empty split has the bound of the one before it and gets no row
    return label_by_rank(keyed, [stratum], "_key", key, bounds, out).drop("_key")


def quota_sample(
    rows: DataFrame,
    group: str,
    key: str,
    mix: Mapping[str, int],
    total: int,
    seed: int = 13,
    strict: bool = True,
    id_column: str | None = None,
) -> DataFrame:
    """Up to ``mix[g]`` rows of each group, then rows of whatever is left up to ``total``.

    Rows left over are those whose ``id_column`` (default: the key) was not taken.  With
    ``strict`` fewer rows than ``total`` raise :class:`ShortfallError`.
    """
    spark = rows.sparkSession
    ident = id_column or key
    wanted = [(g, int(n), g) for g, n in mix.items() if n > 0]
    keyed = rows.withColumn("_key", random_key(seed, key))
    bounds = spark.createDataFrame(wanted, f"{group} string, upto long, bucket string")
    first = cut(label_by_rank(keyed, [group], "_key", key, bounds, "bucket"))
    if sum(n for _, n, _ in wanted) > total:
        first = first.orderBy("_key", key).limit(total)
    have = first.count()
    chosen = first
    if have < total:
        rest = keyed.join(first.select(ident).distinct(), ident, "left_anti").select(keyed.columns).withColumn("_all", F.lit("fill"))
        fill = spark.createDataFrame([("fill", total - have, "fallback")], "_all string, upto long, bucket string")
        chosen = first.union(label_by_rank(rest, ["_all"], "_key", key, fill, "bucket").drop("_all"))
    if strict and have < total:
        chosen = cut(chosen)
        got = chosen.count()
        if got < total:
            raise ShortfallError(f"{got} rows of {total}")
    return chosen.drop("_key")


def bucket_sample(
    rows: DataFrame,
    tags: str,
    key: str,
    mix: Mapping[str, int],
    total: int,
    seed: int = 21,
    strict: bool = True,
    id_column: str | None = None,
    out: str = "bucket",
) -> DataFrame:
    """Greedy sample over overlapping buckets in the order of ``mix``; each id is taken once.

    Every bucket takes the first rows, in random order, of those with its tag that no earlier
    bucket took; the rest up to ``total`` is labelled ``fallback``.
    """
    spark = rows.sparkSession
    ident = id_column or key
    keyed = rows.withColumn("_key", random_key(seed, key)).withColumn("_all", F.lit("fill"))
    taken, left = None, total
    for tag, quota in mix.items():
        if left <= 0 or quota <= 0:
            continue
        tagged = keyed.where(F.array_contains(tags, tag))
        if taken is not None:
            tagged = tagged.join(small(taken.select(ident).distinct()), ident, "left_anti").select(keyed.columns)
        if ident != key:  # the first row of each id stands for it
            best = tagged.groupBy(ident).agg(F.min(F.struct("_key", key)).alias("_b"))
            tagged = tagged.join(best.select(ident, F.col("_b._key").alias("_bk"), F.col(f"_b.{key}").alias("_bt")), ident)
            tagged = tagged.where((F.col("_key") == F.col("_bk")) & (F.col(key) == F.col("_bt"))).select(keyed.columns)
        bound = spark.createDataFrame([("fill", min(quota, left), tag)], f"_all string, upto long, {out} string")
        part = cut(label_by_rank(tagged, ["_all"], "_key", key, bound, out))
        left -= part.count()
        taken = part if taken is None else taken.union(part)
    rest = keyed if taken is None else keyed.join(small(taken.select(ident).distinct()), ident, "left_anti").select(keyed.columns)
    if left > 0:
        bound = spark.createDataFrame([("fill", left, "fallback")], f"_all string, upto long, {out} string")
        part = label_by_rank(rest, ["_all"], "_key", key, bound, out)
        if strict:
            part = cut(part)
            if part.count() < left:
                raise ShortfallError(f"{total - left + part.count()} rows of {total}")
        taken = part if taken is None else taken.union(part)
    return taken.drop("_key", "_all")


def answer_order(a: Column, b: Column, item: Column, seed: int = 13) -> Column:
    """Struct (shown_a, shown_b, swapped): a fair coin per item, the same every time."""
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), item.cast("string"))), 1, 1), 16, 10).cast("int") % 2 == 1
    return F.struct(F.when(coin, b).otherwise(a).alias("shown_a"), F.when(coin, a).otherwise(b).alias("shown_b"), coin.alias("swapped"))
