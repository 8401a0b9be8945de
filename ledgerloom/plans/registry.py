"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import core_queries, reference_queries, reference_sql

_MODULES = (core_queries, reference_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return core_queries.ORACLE | reference_sql.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.p3_found(spark, sf_dir)
