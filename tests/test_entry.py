"""Queries against their SQL on the smallest tables; a failing import of optional parts must not matter."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import registry

CORE = sorted(registry.oracle_sql())
#: Slow ones whose operators have brute-force tests of their own.
LEFT = {"targeted_bucket_sample", "decontaminate_kept", "stratified_split_counts", "tag_counts"}


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view \"{f.split('.')[0]}\" as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in CORE if n not in LEFT])
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted(names) == cols and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
