"""Spelling-proof category labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of the categories, letters and % only.
ALIASES = {
    "%": "percent",
    "pct": "percent",
    "percentage": "percent",
    "percents": "percent",
    "money": "currency",
    "monetary": "currency",
    "num": "number",
    "numeric": "number",
    "numerical": "number",
    "txt": "text",
    "string": "text",
    "ratios": "ratio",
    "arith": "arithmetic",
    "training": "train",
    "trn": "train",
    "validation": "dev",
    "valid": "dev",
    "val": "dev",
    "development": "dev",
    "testing": "test",
    "tst": "test",
}


def letters(c: Column) -> Column:
    """Lower-case letters and ``%`` of a label; null for null and for labels without any."""
    key = F.regexp_replace(F.lower(c), r"[^\p{L}%]+", "")
    return F.when(key == "", F.lit(None)).otherwise(key)


def category(c: Column) -> Column:
    """Canonical key of a label: its letters, with aliases resolved.

    ``Multi Step``, ``multi-step`` and ``multi_step `` all give ``multistep``.
    """
    key = letters(c)
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), key)


def split_name(c: Column) -> Column:
    """``train``, ``dev`` (also validation), ``test`` or null."""
    key = category(c)
    return F.when(key.isin("train", "dev", "test"), key)


def issuer_code(path: Column) -> Column:
    """Upper-case issuer code that a report path or record id names before the year, else null.

    Understands slashes, backslashes, ``%2F``, blanks around separators, ``-`` and ``_``
    as separators, and leading folders.
    """
    plain = F.regexp_replace(F.upper(path), r"%2F|%5C", "/")
    code = F.regexp_extract(plain, r"(?:^|[^\p{L}\p{N}.&])([\p{L}\p{N}.&]+)[\s/\\_-]+(?:19|20)[0-9]{2}[\s/\\_-]", 1)
    return F.when(code == "", F.lit(None)).otherwise(code)
