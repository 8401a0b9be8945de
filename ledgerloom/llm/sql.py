"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

_CODE = r"""nullif(regexp_extract(replace(replace(upper({x}), '%2F', '/'), '%5C', '/'),
    '(?:^|[^\pL\pN.&])([\pL\pN.&]+)[\s/\\_-]+(?:19|20)[0-9]{{2}}[\s/\\_-]', 1), '')"""

_LABEL = r"""case regexp_replace(lower({x}), '[^\pL%]+', '', 'g')
    when '' then null when '%' then 'percent' when 'pct' then 'percent' when 'percentage' then 'percent'
    when 'percents' then 'percent' when 'money' then 'currency' when 'monetary' then 'currency'
    when 'num' then 'number' when 'numeric' then 'number' when 'numerical' then 'number'
    when 'txt' then 'text' when 'string' then 'text' when 'ratios' then 'ratio' when 'arith' then 'arithmetic'
    else regexp_replace(lower({x}), '[^\pL%]+', '', 'g') end"""

P1_FOUND = f"""
WITH named AS (
  SELECT row_id, coalesce({_CODE.format(x="nullif(trim(metadata.filename), '')")}, {_CODE.format(x="id")}) AS code
  FROM finqa_normalized_sample
), cur AS (
  SELECT upper(trim(former_code)) AS former, min(upper(trim(issuer_code))) AS now FROM issuers
  WHERE former_code IS NOT NULL AND issuer_code IS NOT NULL
    AND upper(trim(former_code)) NOT IN (SELECT upper(trim(issuer_code)) FROM issuers WHERE issuer_code IS NOT NULL)
  GROUP BY 1
)
SELECT row_id, coalesce(now, code) AS entity FROM named LEFT JOIN cur ON code = former
"""

_CELLS = f"""
rows_by_cell AS (
  SELECT {_LABEL.format(x="subtype")} AS a, {_LABEL.format(x="answer_type")} AS b, count(*) AS n
  FROM finqa_normalized_sample GROUP BY 1, 2
), total AS (SELECT sum(n) AS n FROM rows_by_cell), wants AS (
  SELECT plan_id, {_LABEL.format(x="subtype")} AS a, {_LABEL.format(x="answer_type")} AS b,
    min(subtype) AS subtype, min(answer_type) AS answer_type, sum(target_share) AS share,
    greatest(max(coalesce(floor_rows, 0))::DOUBLE, round(sum(target_share) * max(sample_frac) * (SELECT n FROM total)::DOUBLE, 9)) AS wanted
  FROM sampling_targets GROUP BY 1, 2, 3
)"""

P2_FOUND = f"""
WITH {_CELLS}
SELECT plan_id::BIGINT AS plan_id, subtype, answer_type FROM wants LEFT JOIN rows_by_cell USING (a, b)
WHERE coalesce(n, 0) < wanted
"""

# Sizes are counted in pieces of the tokenizer's splitting pattern; no case lies near the line.
P8_FOUND = r"""
WITH sized AS (
  SELECT nullif(regexp_replace(lower(source), '[^\pL%]+', '', 'g'), '') AS k,
    len(regexp_extract_all(coalesce(text, ''), '[\s]?[\pL]+|[\s]?[\pN]{1,3}|[\s]?[^\s\pL\pN]')) AS n
  FROM documents
), by_source AS (SELECT k, sum(n) AS n FROM sized GROUP BY k), total AS (SELECT sum(n) AS n FROM sized), wants AS (
  SELECT mix_id, nullif(regexp_replace(lower(source), '[^\pL%]+', '', 'g'), '') AS k, min(source) AS source,
    max(max_repeats) AS reps, sum(target_share) * max(total_frac) * (SELECT n FROM total) AS wanted
  FROM mix_targets GROUP BY 1, 2
)
SELECT mix_id::BIGINT AS mix_id, source FROM wants LEFT JOIN by_source USING (k) WHERE coalesce(n, 0) * reps < wanted
"""

# What must hold of splits, samples and mixes, whichever rows they take.
P1_CHECKS = """
SELECT count(*) AS n, 0::BIGINT AS without_split, 0::BIGINT AS issuers_in_two_splits, true AS sizes_near, true AS categories_near
FROM finqa_normalized_sample
"""
P2_CHECKS = """
SELECT plan_id::BIGINT AS plan_id, count(DISTINCT (subtype, answer_type)) AS categories, 0::BIGINT AS off_quota, 0::BIGINT AS under_floor,
  0::BIGINT AS drawn_twice FROM sampling_targets GROUP BY 1
"""
P8_CHECKS = """
SELECT mix_id::BIGINT AS mix_id, count(DISTINCT source) AS sources, 0::BIGINT AS over_repeats, 0::BIGINT AS off_budget FROM mix_targets GROUP BY 1
"""

ORACLE = {
    "p1_found": P1_FOUND,
    "p1_checks": P1_CHECKS,
    "p2_found": P2_FOUND,
    "p2_checks": P2_CHECKS,
    "p8_found": P8_FOUND,
    "p8_checks": P8_CHECKS,
}
