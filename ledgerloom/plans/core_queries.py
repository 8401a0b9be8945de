"""Queries of the general data operators of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import nested, units
from ledgerloom.session import table


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    issuers = table(spark, d, "issuers")
    golds = units.gold_quantities(table(spark, d, "finqa_normalized_sample"), issuers)
    return golds.union(units.answer_quantities(table(spark, d, "predictions"), issuers))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _quantities(spark, d).where("amount is not null").select("rec_no", "field", "unit", "amount")


def p3_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Every solution with its residual; amounts beyond 64 bits are in ``exact``."""
    return _quantities(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Solutions per field and unit: how many are unique, decided by the residual against nearness, or too large."""
    return _quantities(spark, d).groupBy("field", "unit").agg(
        F.count("*").alias("n"),
        F.count_if("unique").alias("n_unique"),
        F.count_if(~F.col("nearest")).alias("n_overruled"),
        F.count_if(F.col("amount").isNull()).alias("n_quarantined"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_rows(table(spark, d, "finqa_raw_sample")).select("rec_no", "child_kind", "pos", "sub_pos")


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_rows(table(spark, d, "finqa_raw_sample"))


def _node_table(spark: SparkSession, d: str, path: str) -> DataFrame:
    """The rows of one schema path, blank ones included, each with its label and its parent's."""
    nodes = nested.node_tables(nested.report_children(table(spark, d, "finqa_raw_sample")), [path])[path]
    return nodes.select("rec_no", nested.dotted(F.col("label")).alias("label"), nested.dotted(F.col("parent")).alias("parent"), "filled", "value")


def p6_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return _node_table(spark, d, "table[]").drop("value")


def p6_table_cells(spark: SparkSession, d: str) -> DataFrame:
    return _node_table(spark, d, "table[][]")


def p6_schema_paths(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the raw records, whatever their nesting: nodes and filled nodes per schema path."""
    raw = table(spark, d, "finqa_raw_sample")
    nodes = nested.dewey_nodes(raw, "rec_no", [c for c in raw.columns if c != "rec_no"])
    return nodes.groupBy("path").agg(F.count("*").alias("n"), F.count_if("filled").alias("n_filled"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_solutions, p3_report, p6_found, p6_children, p6_table_rows, p6_table_cells, p6_schema_paths)
}

P6_FOUND = r"""
WITH r AS (
  SELECT rec_no, "table" AS t, qa.gold_inds AS g,
    flatten(list_transform(coalesce(pre_text, []), lambda e: CASE WHEN regexp_matches(e, '^\s*\[') AND json_valid(e)
      THEN from_json(e, '["VARCHAR"]') ELSE [e] END)) AS pre,
    flatten(list_transform(coalesce(post_text, []), lambda e: CASE WHEN regexp_matches(e, '^\s*\[') AND json_valid(e)
      THEN from_json(e, '["VARCHAR"]') ELSE [e] END)) AS post
  FROM finqa_raw_sample
), sentences AS (
  SELECT rec_no, 'pre_text' AS kind, unnest(range(len(pre))) AS pos, unnest(pre) AS v, 0 AS shift FROM r
  UNION ALL SELECT rec_no, 'post_text', unnest(range(len(post))), unnest(post), len(pre) FROM r
), filled AS (
  SELECT * FROM sentences WHERE v IS NOT NULL AND NOT regexp_full_match(v, '[\s\pZ]*')
), table_rows AS (SELECT rec_no, unnest(range(len(t))) AS pos, unnest(t) AS cells FROM r),
cells AS (SELECT rec_no, pos, unnest(range(len(cells))) AS sub_pos, unnest(cells) AS v FROM table_rows),
full_cells AS (SELECT * FROM cells WHERE v IS NOT NULL AND NOT regexp_full_match(v, '[\s\pZ]*')),
refs AS (SELECT rec_no, unnest(g) AS e FROM r),
keys AS (
  SELECT rec_no, unnest(list_concat(regexp_extract_all(e, '(?i)^\s*((?:table|text)[_ -]?[0-9]+)\s*$', 1),
    regexp_extract_all(e, '(?i)[{,]\s*["'']\s*((?:table|text)[_ -]?[0-9]+)\s*["'']\s*:', 1))) AS k FROM refs WHERE e IS NOT NULL
), links AS (
  SELECT DISTINCT rec_no, lower(regexp_extract(k, '(?i)(table|text)', 1)) AS kind, regexp_extract(k, '([0-9]+)', 1)::BIGINT AS n FROM keys
)
SELECT rec_no, kind AS child_kind, pos::BIGINT AS pos, -1::BIGINT AS sub_pos FROM filled
UNION ALL SELECT DISTINCT rec_no, 'table_row', pos::BIGINT, -1::BIGINT FROM full_cells
UNION ALL SELECT rec_no, 'table_cell', pos::BIGINT, sub_pos::BIGINT FROM full_cells
UNION ALL SELECT rec_no, 'gold_table', n, -1::BIGINT FROM links WHERE kind = 'table'
  AND EXISTS (SELECT 1 FROM full_cells c WHERE c.rec_no = links.rec_no AND c.pos = n)
UNION ALL SELECT rec_no, 'gold_text', n, -1::BIGINT FROM links WHERE kind = 'text'
  AND EXISTS (SELECT 1 FROM filled f WHERE f.rec_no = links.rec_no AND f.pos + f.shift = n)
"""

_P6 = P6_FOUND.split("SELECT rec_no, kind AS child_kind")[0]
P6_CHILDREN = rf"""{_P6}
SELECT rec_no, kind AS child_kind, pos::BIGINT AS pos, -1::BIGINT AS sub_pos, '' AS parent, v AS value FROM filled
UNION ALL SELECT DISTINCT rec_no, 'table_row', pos::BIGINT, -1::BIGINT, '', NULL FROM full_cells
UNION ALL SELECT rec_no, 'table_cell', pos::BIGINT, sub_pos::BIGINT, pos::VARCHAR, v FROM full_cells
UNION ALL SELECT rec_no, 'gold_table', n, -1::BIGINT, '', NULL FROM links WHERE kind = 'table'
  AND EXISTS (SELECT 1 FROM full_cells c WHERE c.rec_no = links.rec_no AND c.pos = n)
UNION ALL SELECT rec_no, 'gold_text', n, -1::BIGINT, '', NULL FROM links WHERE kind = 'text'
  AND EXISTS (SELECT 1 FROM filled f WHERE f.rec_no = links.rec_no AND f.pos + f.shift = n)
"""
_FILLED = r"(v IS NOT NULL AND NOT regexp_full_match(v, '[\s\pZ]*'))"
P6_TABLE_ROWS = rf"""{_P6}
SELECT rec_no, pos::VARCHAR AS label, '' AS parent,
  len(list_filter(coalesce(cells, []), lambda v: {_FILLED})) > 0 AS filled FROM table_rows
"""
P6_TABLE_CELLS = rf"""{_P6}
SELECT rec_no, pos || '.' || sub_pos AS label, pos::VARCHAR AS parent, {_FILLED} AS filled, v AS value FROM cells
"""
ORACLE: dict[str, str] = {"p6_found": P6_FOUND, "p6_children": P6_CHILDREN, "p6_table_rows": P6_TABLE_ROWS, "p6_table_cells": P6_TABLE_CELLS}
