"""DuckDB SQL for the queries over question records that SQL can express."""

from __future__ import annotations

from ledgerloom.operators.programs import NO_EVIDENCE
from ledgerloom.operators.prompts import DEFAULT
from ledgerloom.operators.sampling import CALCULATION_MIX, TARGETED_MIX

R = "finqa_normalized_sample"
TOKENS = "list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+'), lambda w: lower(w))"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[\s\pZ\x0B\x{{85}}]+|[\s\pZ\x0B\x{{85}}]+$', '', 'g')"


def label(x: str) -> str:
    letters = rf"regexp_replace(lower({x}), '[^\pL%]+', '', 'g')"
    return f"""case {letters} when '' then null when '%' then 'percent' when 'pct' then 'percent' when 'percentage' then 'percent'
      when 'percents' then 'percent' when 'money' then 'currency' when 'monetary' then 'currency' when 'num' then 'number'
      when 'numeric' then 'number' when 'numerical' then 'number' when 'txt' then 'text' when 'string' then 'text'
      when 'ratios' then 'ratio' when 'arith' then 'arithmetic' when 'training' then 'train' when 'trn' then 'train'
      when 'validation' then 'dev' when 'valid' then 'dev' when 'val' then 'dev' when 'development' then 'dev'
      when 'testing' then 'test' when 'tst' then 'test' else {letters} end"""


ORACLE: dict[str, str] = {}

ORACLE["tokenize_count"] = f"SELECT doc_id, len({TOKENS.format(x='text')})::BIGINT AS n_tokens FROM documents"

ORACLE["distinct_ngrams"] = f"""
WITH t AS (SELECT doc_id, {TOKENS.format(x='text')} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) < 5 THEN 0 ELSE
  len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END::BIGINT AS n_grams
FROM t
"""


def _grams(table: str, key: str, text: str, where: str = "true") -> str:
    return f"""SELECT DISTINCT k, g FROM (SELECT k, unnest(list_transform(range(1, len(w) - 11),
      lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) AS g
      FROM (SELECT {key} AS k, {TOKENS.format(x=text)} AS w FROM {table} WHERE {where}) WHERE len(w) >= 13)"""


def _overlap(cand: str, prot: str) -> str:
    return f"""c AS ({cand}), p AS ({prot}), sizes AS (SELECT k, count(*) AS n FROM c GROUP BY k),
      shared AS (SELECT c.k, p.k AS item, count(*) AS s FROM c JOIN p USING (g) GROUP BY 1, 2)"""


_DOCS = _overlap(_grams("documents", "doc_id", "text"), _grams("heldout_items", "item_id", "passage"))
ORACLE["ngram_overlap_pairs"] = f"""
WITH {_DOCS} SELECT k AS doc_id, item AS item_id, s::BIGINT AS shared, round(s / n, 9) AS overlap FROM shared JOIN sizes USING (k)
"""


def _removed(table: str, key: str, where: str, overlap: str) -> str:
    return f"""
WITH {overlap}, best AS (
  SELECT k, max(s / n) AS o, arg_min(item, (-(s / n), item)) AS item FROM shared JOIN sizes USING (k)
  WHERE s / n >= 0.2 GROUP BY k
)
SELECT {key}, o IS NOT NULL AS removed, round(coalesce(o, 0), 9) AS max_overlap, item::VARCHAR AS matched_item
FROM {table} LEFT JOIN best ON k = {key} WHERE {where}
"""


ORACLE["decontaminate_documents"] = _removed("documents", "doc_id", "true", _DOCS)
_SPLIT = label("source_split")
_TRAIN = f"({_SPLIT}) = 'train'"
ORACLE["decontaminate_train"] = _removed(
    R, "row_id", _TRAIN, _overlap(_grams(R, "row_id", "prompt", _TRAIN), _grams(R, "row_id", "prompt", f"({_SPLIT}) IN ('dev', 'test')"))
)
ORACLE["decontaminate_kept"] = f"SELECT row_id FROM ({ORACLE['decontaminate_train']}) WHERE NOT removed"

_MEMBERS = f"""
SELECT row_id, stratum, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train'
  WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT row_id, stratum, count(*) OVER (PARTITION BY stratum) AS n,
        row_number() OVER (PARTITION BY stratum ORDER BY md5('13:' || row_id), row_id) AS r
      FROM (SELECT row_id, {label('subtype')} AS stratum FROM {R}))
"""
ORACLE["stratified_split_members"] = f"SELECT row_id, split FROM ({_MEMBERS})"
ORACLE["stratified_split_counts"] = f"SELECT stratum, split, count(*) AS n FROM ({_MEMBERS}) GROUP BY 1, 2"

_QUOTAS = " ".join(f"WHEN '{k.replace('_', '')}' THEN {n}" for k, n in CALCULATION_MIX.items())
ORACLE["quota_sample"] = f"""
WITH k AS MATERIALIZED (SELECT row_id, {label('subtype')} AS kind, md5('13:' || row_id) AS key FROM {R}),
first AS MATERIALIZED (SELECT row_id, kind AS bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key, row_id) AS r FROM k) WHERE r <= CASE kind {_QUOTAS} ELSE 0 END),
rest AS (SELECT k.*, row_number() OVER (ORDER BY key, row_id) AS r FROM k WHERE row_id NOT IN (SELECT row_id FROM first))
SELECT * FROM first UNION ALL SELECT row_id, 'fallback' FROM rest WHERE r <= 500 - (SELECT count(*) FROM first)
"""

_Q, _P = "coalesce(question, '')", "coalesce(program, '')"
_FOLDED = _P
for _ in range(12):  # innermost argument lists become a mark until only outer calls are left
    _FOLDED = rf"regexp_replace({_FOLDED}, '\([^()]*\)', '<>', 'g')"
_OPS = rf"""list_transform(CASE WHEN regexp_matches({_FOLDED}, '[()]') THEN [] ELSE regexp_extract_all({_FOLDED}, '([A-Za-z_]+)\s*<>', 1) END,
  lambda o: lower(o))"""
_PCT = "lower(coalesce(answer_type, '')) = 'percent'"
_CHANGE = (
    r"(?i)\b(change|changed|increase|increased|decrease|decreased|growth|grew|decline|declined|from|to|compared|versus|vs\.?|"
    r"percent(?:age)? point)\b"
)
_DIRECTION = r"(?i)\b(change|increase|decrease|decline|reduction|lower|higher|less|more|gain|loss|improvement|deterioration)\b"
_AGGREGATE = r"(?i)\b(average|mean|total|sum|combined|aggregate|maximum|minimum|max|min|range)\b"
_UNIT = (
    r"(?i)%|\b(percent|percentage|basis points?|bps|million|millions|billion|billions|thousand|thousands|share of|as a share|"
    r"proportion)\b"
)
_TAGS = rf"""
SELECT row_id, question, answer_type, ops, list_filter([
  CASE WHEN len(list_filter(ops, lambda o: starts_with(o, 'table_'))) > 0 OR (regexp_matches({_Q}, '{_AGGREGATE}')
    AND (coalesce(metadata.raw_table_rows, 0) >= 3 OR contains(coalesce(context, ''), 'Table:'))) THEN 'table_aggregation' END,
  CASE WHEN list_contains(ops, 'subtract') AND (regexp_matches({_P}, '(?i)(^|[\s,(])-\d|const_m\d') OR regexp_matches({_Q}, '{_DIRECTION}'))
    THEN 'sign_direction' END,
  CASE WHEN {_PCT} OR contains(lower({_P}), 'const_100') OR regexp_matches({_Q} || ' ' || {_P}, '{_UNIT}') THEN 'unit_scale' END,
  CASE WHEN list_contains(ops, 'subtract') AND list_contains(ops, 'divide') AND (regexp_matches({_Q}, '{_CHANGE}') OR {_PCT})
    THEN 'percent_change_template' END,
  CASE WHEN len(ops) >= 2 THEN 'multi_step_program' END,
  CASE WHEN coalesce(metadata.raw_table_rows, 0) >= 4
    OR len(regexp_extract_all(coalesce(context, ''), '[-+]?\$?\d[\d,]*(?:\.\d+)?%?')) >= 30 THEN 'source_number_selection' END
  ], lambda x: x IS NOT NULL) AS tags
FROM (SELECT *, {_OPS} AS ops FROM {R})
"""
ORACLE["target_tags"] = f"SELECT row_id, array_to_string(tags, ',') AS tags FROM ({_TAGS})"
ORACLE["tag_counts"] = f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ({_TAGS})) GROUP BY tag"
ORACLE["operation_class"] = f"""
SELECT row_id, CASE WHEN list_contains(ops, 'greater') THEN 'comparison'
  WHEN list_contains(tags, 'percent_change_template') THEN 'percent_change'
  WHEN list_contains(tags, 'table_aggregation') THEN 'table_aggregation'
  WHEN list_contains(ops, 'multiply') AND (list_contains(tags, 'unit_scale') OR contains(lower({_Q}), 'share')) THEN 'unit_scale'
  WHEN list_contains(ops, 'multiply') THEN 'product_or_share'
  WHEN list_contains(ops, 'divide') AND NOT list_contains(ops, 'subtract') THEN 'ratio'
  WHEN list_contains(ops, 'subtract') AND NOT list_contains(ops, 'divide') THEN 'difference'
  WHEN len(ops) >= 2 THEN 'multi_step' WHEN list_contains(ops, 'add') THEN 'sum_or_lookup'
  WHEN {_PCT} THEN 'percent' ELSE 'other' END AS operation_class
FROM ({_TAGS})
"""


def _buckets() -> str:
    parts, left = [], 2000
    names: list[str] = []
    for i, (tag, n) in enumerate(TARGETED_MIX.items()):
        quota = min(n, left)
        left -= quota
        seen = " AND ".join(f"row_id NOT IN (SELECT row_id FROM b{j})" for j in range(i)) or "true"
        parts.append(
            f"b{i} AS MATERIALIZED (SELECT row_id, '{tag}' AS bucket FROM k WHERE list_contains(tags, '{tag}') AND {seen} "
            f"ORDER BY key, row_id LIMIT {quota})"
        )
        names.append(f"b{i}")
    union = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return f"""
WITH k AS MATERIALIZED (SELECT row_id, tags, md5('21:' || row_id) AS key FROM ({_TAGS})), {", ".join(parts)},
taken AS MATERIALIZED ({union}),
rest AS (SELECT row_id, row_number() OVER (ORDER BY key, row_id) AS r FROM k WHERE row_id NOT IN (SELECT row_id FROM taken))
SELECT * FROM taken UNION ALL SELECT row_id, 'fallback' FROM rest WHERE r <= 2000 - (SELECT count(*) FROM taken)
"""


ORACLE["targeted_bucket_sample"] = _buckets()

_RATIO = r"(?i)\b(percent|percentage|ratio|margin|rate|yield|per share|bps|basis point|growth)\b"
_OPCALL = r"(?i)\b(add|subtract|multiply|divide|exp|greater|table_sum|table_average|table_max|table_min)\s*\("
_ABSTAIN3 = r"(?i)\b(not enough information|cannot determine|insufficient information)\b"


def answer_type(gold: str, question: str) -> str:
    both = f"(coalesce({gold}, '') || ' ' || coalesce({question}, ''))"
    return rf"""CASE WHEN regexp_matches({both}, '(?i)%|\b(percent|percentage|basis points?|bps)\b') THEN 'percent'
      WHEN regexp_matches({both}, '(?i)[$€£]|\b(dollars?|usd|million|billion|thousand)\b') THEN 'currency'
      WHEN regexp_matches(coalesce({gold}, ''), '\d') THEN 'number' ELSE 'text' END"""


def subtype(question: str, program: str, gold: str) -> str:
    p = f"coalesce({program}, '')"
    ops = f"len(regexp_extract_all({p}, '{_OPCALL}'))"
    return rf"""CASE WHEN regexp_matches(coalesce({gold}, ''), '{_ABSTAIN3}') THEN 'unanswerable'
      WHEN regexp_matches(coalesce({question}, '') || ' ' || {p}, '{_RATIO}') OR contains(lower({p}), 'divide(') THEN 'ratio'
      WHEN {ops} >= 2 THEN 'multi_step' WHEN {ops} = 1 THEN 'arithmetic' ELSE 'lookup' END"""


ORACLE["infer_labels"] = f"SELECT row_id, {answer_type('gold', 'question')} AS answer_type, {subtype('question', 'program', 'gold')} AS subtype FROM {R}"
ORACLE["count_labels"] = f"SELECT subtype, answer_type, count(*) AS n FROM {R} GROUP BY 1, 2"

_TABLE = f"""array_to_string(list_filter(list_transform(list_filter(coalesce("table", []), lambda r: r IS NOT NULL),
  lambda r: array_to_string(list_transform(r, lambda x: {strip('x')}), ' | ')), lambda r: {strip('r')} <> ''), chr(10))"""


def _list(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []), lambda e: {strip('e')}), lambda e: e <> '')"


ORACLE["table_serialize"] = f"SELECT rec_no, {_TABLE} AS table_text FROM finqa_raw_sample"
ORACLE["normalize_records"] = f"""
WITH a AS (
  SELECT rec_no, {strip('id')} AS id, {strip('qa.question')} AS question, {strip('qa.exe_ans')} AS gold, {strip('qa.program')} AS program,
    {_list('pre_text')} AS pre, {_list('post_text')} AS post, {_TABLE} AS tab,
    coalesce(len(qa.gold_inds), 0)::BIGINT AS n_evidence, coalesce(len("table"), 0)::BIGINT AS raw_table_rows
  FROM finqa_raw_sample
), b AS (
  SELECT *, {strip('''concat_ws(chr(10) || chr(10), CASE WHEN len(pre) > 0 THEN 'Pre-text:' || chr(10) || array_to_string(pre, chr(10)) END,
    CASE WHEN tab <> '' THEN 'Table:' || chr(10) || tab END,
    CASE WHEN len(post) > 0 THEN 'Post-text:' || chr(10) || array_to_string(post, chr(10)) END)''')} AS context FROM a
)
SELECT rec_no, id, {subtype('question', 'program', 'gold')} AS subtype, {answer_type('gold', 'question')} AS answer_type,
  md5(context) AS context_md5, question, gold,
  md5({strip("'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question")}) AS prompt_md5,
  program, n_evidence, raw_table_rows, program <> '' AS has_program,
  CASE WHEN id = '' THEN 'missing_id' WHEN question = '' THEN 'missing_question' WHEN gold = '' THEN 'missing_gold'
    WHEN context = '' THEN 'missing_context' END AS error
FROM b
"""

_VALUE = f"try_cast(regexp_replace({strip('gold')}, '[,$%]', '', 'g') AS DECIMAL(38, 10))"


def _decimal(x: str, places: int, commas: bool = False) -> str:
    cut = f"regexp_replace(({x})::DECIMAL(36, {places})::VARCHAR, '\\.?0+$', '')"
    if commas:
        grouped = f"format('{{:,.{places}f}}', ({x})::DECIMAL(30, {places})::DOUBLE)"
        cut = f"regexp_replace({grouped}, '\\.?0+$', '')"
    return f"CASE WHEN ({x})::DECIMAL(36, {places}) = 0 THEN '0' ELSE {cut} END"


ORACLE["gold_text"] = f"""
SELECT row_id, CASE WHEN v IS NULL THEN {strip('gold')}
  WHEN lower(coalesce(answer_type, '')) = 'percent' THEN {_decimal("CASE WHEN abs(v) <= 1 THEN v * 100 ELSE v END", 1)} || '%'
  WHEN lower(coalesce(answer_type, '')) = 'currency' THEN '$' || {_decimal("v", 2, True)}
  ELSE {_decimal("v", 2)} END AS answer
FROM (SELECT *, {_VALUE}::DECIMAL(30, 10) AS v FROM {R})
"""

ORACLE["evidence_hint"] = f"""
SELECT row_id, CASE WHEN len(e) = 0 THEN '{NO_EVIDENCE}' ELSE array_to_string(list_slice(e, 1, 2), '; ') END AS hint
FROM (SELECT row_id, {_list('evidence')} AS e FROM {R})
"""

_TASK = DEFAULT.answer_task.replace("'", "''")


def _prompt(task: str, tail: str = "") -> str:
    """Digest of the user message with context, question and task."""
    quoted = task.replace("'", "''")
    return "md5(" + strip(f"'Context:' || chr(10) || {strip('context')} || chr(10) || chr(10) || 'Question: ' || {strip('question')} || chr(10) || chr(10) || '{quoted}'{tail}") + ")"


for _name, _system, _task in (
    ("program_prompts", DEFAULT.program_system, DEFAULT.program_task),
    ("source_prompts", DEFAULT.source_system, DEFAULT.source_task),
):
    ORACLE[_name] = f"""
SELECT row_id, '{_system.replace("'", "''")}' AS system, {_prompt(_task, " || chr(10) || chr(10) || '/no_think'")} AS user_md5 FROM {R}
"""
ORACLE["offline_abstain"] = f"SELECT row_id, 'Final answer: not enough information' AS prediction, 'offline_abstain' AS finish_reason FROM {R}"
ORACLE["model_errors"] = f"SELECT row_id, 'Final answer: not enough information' AS prediction, 'model_error' AS finish_reason FROM {R}"
ORACLE["finish_reasons"] = "SELECT coalesce(finish_reason, '(none)') AS finish_reason, count(*) AS n FROM predictions GROUP BY 1"
ORACLE["table_programs"] = """
SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN max(l_quantity::BIGINT)::VARCHAR WHEN 1 THEN min(l_quantity::BIGINT)::VARCHAR
  ELSE sum(l_quantity::BIGINT)::VARCHAR END AS answer FROM lineitem GROUP BY l_orderkey
"""
ORACLE["calculator_ops"] = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ((o_orderkey % 97)::BIGINT * (o_orderkey % 97)::BIGINT)::VARCHAR
  WHEN 1 THEN (o_orderkey::BIGINT * 3)::VARCHAR WHEN 2 THEN (o_orderkey::BIGINT + 5)::VARCHAR
  WHEN 3 THEN CASE WHEN o_orderkey > 100 THEN 'yes' ELSE 'no' END ELSE (((o_orderkey + 1) * 2 - 7)::BIGINT)::VARCHAR END AS answer FROM orders
"""
ORACLE["answer_prompts"] = f"""
SELECT row_id, '{DEFAULT.answer_system.replace("'", "''")}' AS system,
  md5({strip(f"'Context:' || chr(10) || {strip('context')} || chr(10) || chr(10) || 'Question: ' || {strip('question')} || chr(10) || chr(10) || '{_TASK}' || CASE WHEN coalesce(program, '') <> '' THEN chr(10) || chr(10) || 'Reasoning program hint: ' || program ELSE '' END || chr(10) || chr(10) || '/no_think'")}) AS user_md5
FROM {R}
"""
_GOLD = strip("gold")
ORACLE["answer_chat"] = f"""
SELECT row_id, 'system,user,assistant' AS roles, md5(coalesce(prompt, '')) AS user_md5,
  CASE WHEN starts_with(lower({_GOLD}), 'final answer:') THEN {_GOLD} ELSE 'Final answer: ' || {_GOLD} END AS assistant
FROM {R}
"""
ORACLE["chat_validate"] = rf"""
SELECT row_id, array_to_string(list_filter([
  CASE WHEN {strip('program')} = '' THEN 'missing_assistant_content' END,
  CASE WHEN regexp_matches({strip('program')}, '[\r\n]') THEN 'assistant_content_not_one_line' END,
  CASE WHEN regexp_matches(lower({strip('program')}), 'final answer:|evidence:|calculation:|```')
    THEN 'assistant_content_contains_non_program_text' END], lambda x: x IS NOT NULL), ',') AS errors
FROM {R}
"""

ORACLE["program_operands"] = rf"""
WITH a AS (
  SELECT row_id, list_filter(list_transform(string_split(regexp_replace({_P}, '[A-Za-z_]+\s*\(|\)', '', 'g'), ','), lambda a: trim(a)),
    lambda a: a <> '' AND NOT starts_with(a, '#')) AS l FROM {R}
), u AS (SELECT row_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM a)
SELECT row_id, coalesce(array_to_string(list_filter(l, lambda x: NOT starts_with(x, 'const_')), ' '), '') AS source_numbers,
  coalesce(array_to_string(list_filter(l, lambda x: starts_with(x, 'const_')), ' '), '') AS constants
FROM u
"""
ORACLE["program_op_counts"] = f"SELECT op, count(*) AS n FROM (SELECT unnest({_OPS}) AS op FROM {R}) GROUP BY op"
ORACLE["program_extract"] = f"SELECT row_id, CASE WHEN program IS NOT NULL AND trim(program) <> '' THEN program END AS program FROM {R}"

ORACLE["calculator_exec"] = """
WITH c AS (
  SELECT l_orderkey, l_linenumber, (l_extendedprice::DECIMAL(18, 2) * 100)::HUGEINT AS p, (l_quantity::DECIMAL(18, 2) * 100)::HUGEINT AS q FROM lineitem
), r AS (SELECT *, sign(p - q)::HUGEINT * ((2 * abs(p - q) * 1000000 + q) // (2 * q)) AS m FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN m = 0 THEN '0' ELSE
  CASE WHEN m < 0 THEN '-' ELSE '' END || (abs(m) // 1000000)::VARCHAR ||
  regexp_replace('.' || lpad((abs(m) % 1000000)::VARCHAR, 6, '0'), '\\.?0+$', '') END AS answer
FROM r
"""
ORACLE["calculator_errors"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_totalprice::DECIMAL(18, 2) > 150000 THEN 'yes' ELSE 'no' END END AS answer,
  CASE o_orderkey % 3 WHEN 0 THEN 'divide failed' WHEN 1 THEN 'reference out of range' END AS error
FROM orders
"""

_TEXT = "coalesce(tuned_answer, '')"
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
ORACLE["final_answer_extract"] = rf"""
WITH l AS (SELECT pred_no, {_TEXT} AS t, regexp_split_to_array({_TEXT}, '{_BREAK}') AS ls FROM predictions),
m AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)\bfinal\s+answer\s*:')), true) AS i FROM l),
f AS (SELECT *, coalesce(i, 0) > 0 AS found FROM m),
s AS (SELECT *, CASE WHEN found THEN {strip(r"regexp_extract(ls[i], '(?i)\bfinal\s+answer\s*:\s*(.*)$', 1)")} END AS same,
  CASE WHEN found THEN list_filter(list_transform(list_slice(ls, i + 1, len(ls)), lambda x: {strip('x')}), lambda x: x <> '') END AS after FROM f)
SELECT pred_no, CASE WHEN NOT found THEN {strip('t')} WHEN same <> '' THEN same ELSE coalesce(after[1], '') END AS answer, found FROM s
"""
ORACLE["format_violation"] = rf"""
WITH l AS (SELECT pred_no, list_filter(list_transform(regexp_split_to_array({_TEXT}, '{_BREAK}'), lambda x: {strip('x')}), lambda x: x <> '') AS ls
  FROM predictions)
SELECT pred_no, NOT (len(ls) = 1 AND regexp_matches(ls[1], '(?i)^final\s+answer\s*:\s*.+$')) AS violation FROM l
"""
_ABSTAIN4 = r"(?i)\b(not enough information|cannot determine|can''t determine|insufficient information)\b"
ORACLE["abstention_flag"] = rf"""
SELECT pred_no, regexp_matches({_TEXT}, '{_ABSTAIN4}') AS tuned, regexp_matches(coalesce(gold, ''), '{_ABSTAIN4}') AS gold_abstains FROM predictions
"""
ORACLE["normalize_text"] = rf"""
SELECT pred_no, trim(regexp_replace(lower({strip(_TEXT)}), '[^a-z0-9.%$€£+-]+', ' ', 'g')) AS answer FROM predictions
"""
_NUM = (
    r"(?i)(?:^|[^A-Za-z0-9])((?:[$€£])?\s*[-+]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)\s*"
    r"(?:thousand|million|billion|trillion|mn|mm|bn|m|b|k)?\s*(?:%|percent|percentage\s+points?|points?|basis\s+points?|bps)?)"
)
ORACLE["offline_first_number"] = rf"""
SELECT row_id, 'Final answer: ' || CASE WHEN regexp_matches(coalesce(context, ''), '{_NUM}')
  THEN {strip(f"regexp_extract(context, '{_NUM}', 1)")} ELSE 'not enough information' END AS prediction, 'offline_first_number' AS finish_reason
FROM {R}
"""
ORACLE["offline_gold"] = f"SELECT row_id, 'Final answer: ' || coalesce(gold, '') AS prediction FROM {R}"

_RUN = """
SELECT l_orderkey, l_linenumber, l_returnflag, p, s, l_orderkey % 2 = 1 AS violation, abs(s - p) <= greatest(0.005, 0.001 * greatest(s, p)) AS hit
FROM (SELECT *, (p * ([1.0000, 1.0004, 1.0020, 1.0500]::DECIMAL(6, 4)[])[l_linenumber % 4 + 1])::DECIMAL(18, 2) AS s
      FROM (SELECT *, l_extendedprice::DECIMAL(18, 2) AS p FROM lineitem))
"""
ORACLE["numeric_match"] = f"""
SELECT l_orderkey, l_linenumber, CASE WHEN violation THEN 'It was $' ELSE '$' END || s::VARCHAR AS extracted_answer,
  violation AS format_violation, hit AND NOT violation AS correct, NOT hit AS hallucinated_figure FROM ({_RUN})
"""
ORACLE["score_summary"] = f"""
SELECT coalesce(l_returnflag, '(all)') AS subtype, count(*) AS n, round(avg((hit AND NOT violation)::INT::DOUBLE), 9) AS exact_match,
  round(avg(violation::INT::DOUBLE), 9) AS format_violation_rate, round(avg((NOT hit)::INT::DOUBLE), 9) AS hallucinated_figure_rate
FROM ({_RUN}) GROUP BY GROUPING SETS ((l_returnflag), ())
"""
ORACLE["answer_order"] = """
SELECT pred_no, contains('13579bdf', substring(md5('13:' || pred_no), 1, 1)) AS swapped FROM predictions
"""

_FLAGS = "(SELECT o_orderpriority, o_totalprice > 150000 AS a, o_custkey % 2 = 0 AS b FROM orders)"
ORACLE["paired_compare"] = f"""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_a,
  count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither,
  round(avg(b::INT::DOUBLE - a::INT::DOUBLE), 9) AS delta
FROM {_FLAGS} GROUP BY o_orderpriority
"""
ORACLE["mcnemar"] = f"""
WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE NOT a AND b) AS y FROM {_FLAGS} GROUP BY 1)
SELECT o_orderpriority, round(CASE WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(x, y) + 1),
  lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))))) END, 9) AS p_value FROM c
"""
ORACLE["cohen_kappa"] = """
WITH l AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS b FROM lineitem),
t AS (SELECT count(*) AS n, avg((a = b)::INT::DOUBLE) AS o FROM l),
e AS (SELECT sum(x.c::DOUBLE * y.c) AS s FROM (SELECT a, count(*) AS c FROM l GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM l GROUP BY b) y ON a = b)
SELECT n, round(o, 9) AS observed, round(s / (n::DOUBLE * n), 9) AS expected, round((o - s / (n::DOUBLE * n)) / (1 - s / (n::DOUBLE * n)), 9) AS kappa
FROM t, e
"""
ORACLE["bootstrap_ci"] = """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS r, (s_acctbal > 4000)::INT::DOUBLE AS v FROM supplier),
n AS (SELECT count(*) AS n FROM v),
draws AS (SELECT b, ('0x' || substring(md5('13:' || b || ':' || i), 1, 12))::BIGINT % n AS r
          FROM range(2000) x(b), n, range((SELECT count(*) FROM v)) y(i)),
m AS (SELECT b, sum(v) / (SELECT n FROM n) AS m FROM draws JOIN v USING (r) GROUP BY b), s AS (SELECT list_sort(list(m)) AS l FROM m)
SELECT (SELECT n FROM n) AS n, round(l[51], 9) AS low, round(l[1951], 9) AS high FROM s
"""
ORACLE["resume_pending"] = f"""
SELECT row_id, id FROM {R} WHERE ({_SPLIT}) IN ('dev', 'test') AND (id IS NULL OR id NOT IN (SELECT id FROM predictions WHERE id IS NOT NULL))
"""
ORACLE["select_rows"] = """
SELECT o_orderkey AS id, o_totalprice::DECIMAL(18, 2) AS total FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey LIMIT 500
"""
ORACLE["json_props"] = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"
