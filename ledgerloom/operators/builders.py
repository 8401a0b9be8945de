"""Training sets: targets that can be built, sampled to a mix, as rows and as chat records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import sampling, targets
from ledgerloom.session import cut

_KEY = "_row"


def without(rows: DataFrame, exclude: DataFrame | None, key: str = "id") -> DataFrame:
    """``rows`` whose key is not among those of ``exclude``; this comes before any target is built."""
    return rows if exclude is None else rows.join(exclude.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_anti").select(rows.columns)


def _numbered(built: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """Targets under a unique key, built once: ``key``, or a number that is written with them."""
    return (cut(built), key) if key is not None else (cut(built.withColumn(_KEY, F.monotonically_increasing_id())), _KEY)


def _by_subtype(built: DataFrame, mix: Mapping[str, int], total: int, seed: int, strict: bool, key: str | None) -> DataFrame:
    rows, unique = _numbered(built, key)
    return sampling.quota_sample(rows, "subtype", unique, mix, total, seed, strict, "id").drop("bucket", _KEY)


def _by_tags(built: DataFrame, tags: str, bucket: str, mix: Mapping[str, int], total: int, seed: int, strict: bool, key: str | None) -> DataFrame:
    rows, unique = _numbered(built, key)
    return sampling.bucket_sample(rows, tags, unique, mix, total, seed, strict, "id", bucket).drop(_KEY)


def calculation_set(
    rows: DataFrame, total: int = 500, seed: int = 13, mix: Mapping[str, int] = sampling.CALCULATION_MIX, strict: bool = True, key: str | None = None
) -> DataFrame:
    """``total`` calculation targets, ``mix`` of them per subtype, the rest filled from what is left.

    Too few rows raise :class:`~ledgerloom.operators.sampling.ShortfallError` unless
    ``strict`` is false.  ``key`` names a unique column; without one rows are numbered.
    """
    return _by_subtype(targets.calculation_targets(rows), mix, total, seed, strict, key)


def reasoning_set(
    rows: DataFrame, total: int = 1000, seed: int = 13, mix: Mapping[str, int] = sampling.REASONING_MIX, strict: bool = True, key: str | None = None
) -> DataFrame:
    """The same with the answer line and the reasoning apart."""
    return _by_subtype(targets.reasoning_targets(rows), mix, total, seed, strict, key)


def program_set(
    rows: DataFrame,
    total: int = 1000,
    seed: int = 13,
    mix: Mapping[str, int] = sampling.PROGRAM_MIX,
    exclude: DataFrame | None = None,
    strict: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Program targets per subtype; ids of ``exclude`` are left out before programs are run."""
    return _by_subtype(targets.program_targets(without(rows, exclude)), mix, total, seed, strict, key)


def targeted_set(
    rows: DataFrame,
    total: int = 2000,
    seed: int = 21,
    mix: Mapping[str, int] = sampling.TARGETED_MIX,
    exclude: DataFrame | None = None,
    strict: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Program targets by failure-mode tags, with ``targeted_program_tags`` and ``targeted_selection_bucket``."""
    built = targets.with_tags(targets.program_targets(without(rows, exclude)), "targeted_program_tags")
    return _by_tags(built, "targeted_program_tags", "targeted_selection_bucket", mix, total, seed, strict, key)


def source_set(
    rows: DataFrame,
    total: int = 2000,
    seed: int = 34,
    mix: Mapping[str, int] = sampling.SOURCE_MIX,
    exclude: DataFrame | None = None,
    strict: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Source-number targets by tags, with ``source_program_tags`` and ``source_program_selection_bucket``."""
    built = targets.source_targets(without(rows, exclude))
    return _by_tags(built, "source_program_tags", "source_program_selection_bucket", mix, total, seed, strict, key)
