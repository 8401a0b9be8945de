"""Rates, paired tests, agreement and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import row_numbers
from ledgerloom.session import cut, small


def rate(c: Column) -> Column:
    """Share of true values; 0 for no rows."""
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def paired_counts(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, both, only_a, only_b, neither and delta (mean of b minus a) of paired flags, per group."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    return pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"),
        F.count_if(~x & ~y).alias("neither"),
        F.coalesce(F.avg(y.cast("double") - x.cast("double")), F.lit(0.0)).alias("delta"),
    )


#: Terms of a binomial tail that are summed at a time; a sum ends when further terms no longer change it.
CHUNK = 65_536


def _log_tail(k: int, n: int) -> float:
    """Logarithm of the sum of C(n, i) for i up to ``k`` (at most n / 2), from its largest term down."""
    from math import lgamma, log

    top = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    total, last, i = 1.0, 0.0, k
    while i > 0:
        # C(n, i - 1) / C(n, i) = i / (n - i + 1)
        at = np.arange(i, max(i - CHUNK, 0), -1, dtype=np.float64)
        logs = last + np.cumsum(np.log(at) - np.log(n - at + 1))
        more = float(np.exp(logs).sum())
        total, last, i = total + more, float(logs[-1]), i - len(at)
        if more <= total * 1e-17 or last < -60:
            break
    return top + log(total)


def _tail(extreme: pd.Series, total: pd.Series) -> pd.Series:
    from math import exp, log

    out = []
    for k, n in zip(extreme, total):
        if n == 0:
            out.append(1.0)
        elif n < 1000:
            out.append(min(1.0, 2 * sum(comb(int(n), i) for i in range(int(k) + 1)) / 2 ** int(n)))
        else:
            out.append(min(1.0, exp(log(2.0) + _log_tail(int(k), int(n)) - n * log(2.0))))
    return pd.Series(out)


def exact_pvalue(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact McNemar p-value from the discordant counts, in log space."""
    return F.pandas_udf(_tail, "double")(F.least(only_a, only_b), only_a + only_b)


def mcnemar(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    counts = paired_counts(pairs, a, b, by)
    return counts.withColumn("p_value", exact_pvalue(F.col("only_a"), F.col("only_b")))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa) of Cohen's kappa; 0 for no rows, 1 where chance agreement is complete."""
    cells = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n"))), F.lit(0)).alias("same"))
    left = cells.groupBy("a").agg(F.sum("n").alias("x"))
    right = cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = left.join(right, F.col("a").eqNullSafe(F.col("b"))).agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    n = F.col("n").cast("double")
    out = total.crossJoin(F.broadcast(chance)).select(
        "n",
        F.coalesce(F.try_divide(F.col("same").cast("double"), n), F.lit(0.0)).alias("observed"),
        F.coalesce(F.try_divide("xy", n * n), F.lit(0.0)).alias("expected"),
    )
    value = F.when(F.col("n") == 0, 0.0).when(F.col("expected") == 1, 1.0).otherwise(
        (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0))
    )
    return out.withColumn("kappa", value)


def _bounds(n: int, confidence: float) -> tuple[int, int]:
    alpha = 1 - confidence
    return max(0, int(alpha / 2 * n)), min(n - 1, int((1 - alpha / 2) * n))


def bootstrap_ci(values: DataFrame, value: str, key: str, resamples: int = 2000, confidence: float = 0.95, seed: int = 13) -> DataFrame:
    """One row (n, low, high): percentile interval of the mean by hash-indexed resampling.

    Draw i of resample b takes the row whose rank is ``md5(seed:b:i) mod n``, so any engine
    gives the same interval.  The n x resamples draws look their values up where they are
    made, and only a sum per resample is shuffled; values too many to broadcast are joined
    to the shuffled draws.  For large binary data use :func:`binary_ci`.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    if resamples <= 0:
        raise ValueError("resamples must be positive")
    ranked = cut(row_numbers(values.select(key, F.col(value).cast("double").alias("v")), key, "r").select("r", "v"))
    n = ranked.count()
    at = F.concat_ws(":", F.lit(str(seed)), F.expr(f"string(id div {max(n, 1)})"), (F.col("id") % max(n, 1)).cast("string"))
    # never null for the optimizer, which would else digest each draw twice: to test for null and to join
    spot = F.coalesce(F.conv(F.substring(F.md5(at), 1, 12), 16, 10).cast("long") % max(n, 1), F.lit(0).cast("long"))
    draws = values.sparkSession.range(resamples * n).select(F.expr(f"id div {max(n, 1)}").alias("b"), spot.alias("r"))
    means = draws.join(small(ranked), "r").groupBy("b").agg((F.sum("v") / F.lit(n)).alias("m"))
    low, high = _bounds(resamples, confidence)
    sorted_ = means.agg(F.array_sort(F.collect_list("m")).alias("s"))
    pick = lambda i: F.coalesce(F.get("s", F.lit(i)), F.lit(0.0))
    return sorted_.select(F.lit(n).cast("long").alias("n"), pick(low).alias("low"), pick(high).alias("high"))


def parity_ci(
    values: list, resamples: int = 2000, confidence: float = 0.95, seed: int = 13, statistic: Callable[[list], float] | None = None
) -> tuple[float, float]:
    """Percentile interval of a statistic (the mean) with Python's own generator, for small samples on the driver."""
    import random

    if not values:
        return 0.0, 0.0
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    if resamples <= 0:
        raise ValueError("resamples must be positive")
    draw = random.Random(seed).randrange
    n = len(values)
    measure = statistic or (lambda v: sum(v) / len(v))
    means = sorted(measure([values[draw(n)] for _ in range(n)]) for _ in range(resamples))
    low, high = _bounds(resamples, confidence)
    return means[low], means[high]


def poisson_ci(values: DataFrame, value: str, key: str, resamples: int = 200, confidence: float = 0.95, seed: int = 13) -> DataFrame:
    """One row (n, low, high): percentile interval of the mean by Poisson weights, in one pass over any number of rows.

    Each row counts in resample b as often as a Poisson variable that its key, b and the seed
    decide; only sums per resample are shuffled.
    """
    low, high = _bounds(resamples, confidence)
    steps = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(9)])
    share = F.pmod(F.xxhash64(key, F.col("b"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    weight = sum((F.when(share >= float(s), 1).otherwise(0) for s in steps), F.lit(0))
    runs = values.select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    sums = runs.withColumn("w", weight).groupBy("b").agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("s"), F.count("*").alias("n"))
    means = sums.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.try_divide("s", F.col("w").cast("double")))).alias("m"))
    pick = lambda i: F.coalesce(F.get("m", F.lit(i)), F.lit(0.0))
    return means.select("n", pick(low).alias("low"), pick(high).alias("high"))


def binary_ci(n: Column, hits: Column, minus: Column | None = None, resamples: int = 2000, confidence: float = 0.95, seed: int = 13) -> Column:
    """Struct (low, high) of the bootstrap of a rate, drawn from its exact (multi)nomial distribution.

    ``minus`` counts values of -1 (paired differences).  The cost does not depend on n.
    """
    low, high = _bounds(resamples, confidence)

    def run(n_: pd.Series, plus: pd.Series, less: pd.Series) -> pd.DataFrame:
        out = []
        for total, p, m in zip(n_, plus, less):
            if not total:
                out.append((0.0, 0.0))
                continue
            draws = np.random.default_rng(seed).multinomial(int(total), [p / total, m / total, max(0.0, 1 - (p + m) / total)], resamples)
            means = np.sort((draws[:, 0] - draws[:, 1]) / total)
            out.append((float(means[low]), float(means[high])))
        return pd.DataFrame(out, columns=["low", "high"])

    return F.pandas_udf(run, "low double, high double")(n, hits, F.lit(0).cast("long") if minus is None else minus)
