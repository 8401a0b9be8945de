"""Queries of the question-answering operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as num
from ledgerloom.functions import text as txt
from ledgerloom.functions.labels import category, split_name
from ledgerloom.operators import builders
from ledgerloom.operators import decontaminate as dec
from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import generate as gen
from ledgerloom.operators import normalize as norm
from ledgerloom.operators import programs as prog
from ledgerloom.operators import prompts, sampling, stats, targets
from ledgerloom.session import spread, table

RECORDS = "finqa_normalized_sample"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, RECORDS)


def _unique(rows: DataFrame) -> DataFrame:
    """Records under their row number, as file ids are not unique."""
    return rows.withColumn("id", F.col("row_id").cast("string"))


# documents ------------------------------------------------------------------


def tokenize_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(txt.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def distinct_ngrams(spark, d):
    t = txt.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(txt.ngrams(t, 5))).cast("long").alias("n_grams"))


def ngram_overlap_pairs(spark, d):
    out = dec.overlaps(table(spark, d, "documents"), table(spark, d, "heldout_items"), "doc_id", "text", "item_id", "passage", 13)
    return out.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.col("shared").cast("long").alias("shared"), F.round("overlap", 9).alias("overlap"))


def decontaminate_documents(spark, d):
    return dec.decontaminate(table(spark, d, "documents"), table(spark, d, "heldout_items"), "doc_id", "text", "item_id", "passage")


def decontaminate_train(spark, d):
    rows = _records(spark, d).withColumn("s", split_name(F.col("source_split")))
    return dec.decontaminate(rows.where("s = 'train'"), rows.where("s <> 'train'"), "row_id", "prompt", "row_id", "prompt")


def decontaminate_kept(spark, d):
    return decontaminate_train(spark, d).where("not removed").select("row_id")


# splits and samples -----------------------------------------------------------


def stratified_split_members(spark, d):
    rows = _records(spark, d).select("row_id", category(F.col("subtype")).alias("stratum"))
    return sampling.stratified_split(rows, "stratum", "row_id").select("row_id", "split")


def stratified_split_counts(spark, d):
    rows = _records(spark, d).select("row_id", category(F.col("subtype")).alias("stratum"))
    return sampling.stratified_split(rows, "stratum", "row_id").groupBy("stratum", "split").agg(F.count("*").alias("n"))


def quota_sample(spark, d):
    rows = _records(spark, d).select("row_id", category(F.col("subtype")).alias("kind"))
    mix = {k.replace("_", ""): n for k, n in sampling.CALCULATION_MIX.items()}
    return sampling.quota_sample(rows, "kind", "row_id", mix, 500, strict=False).select("row_id", "bucket")


def _tagged(spark, d):
    r = _records(spark, d)
    ops = prog.program_ops(F.col("program"))
    tags = prog.target_tags(F.col("program"), F.col("question"), F.col("context"), F.col("answer_type"), F.col("metadata.raw_table_rows"), ops, F.size(ops))
    return r.select("row_id", "question", "answer_type", ops.alias("ops"), tags.alias("tags"))


def target_tags(spark, d):
    return _tagged(spark, d).select("row_id", F.array_join("tags", ",").alias("tags"))


def operation_class(spark, d):
    cls = prog.operation_class(F.col("ops"), F.col("tags"), F.col("question"), F.col("answer_type"))
    return _tagged(spark, d).select("row_id", cls.alias("operation_class"))


def tag_counts(spark, d):
    return _tagged(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def targeted_bucket_sample(spark, d):
    tagged = _tagged(spark, d).select("row_id", "tags")
    return sampling.bucket_sample(tagged, "tags", "row_id", sampling.TARGETED_MIX, 2000, strict=False).select("row_id", "bucket")


# records ------------------------------------------------------------------------


def normalize_records(spark, d):
    n = norm.normalize_records(table(spark, d, "finqa_raw_sample"), keep=("rec_no",))
    return n.select(
        "rec_no",
        "id",
        "subtype",
        "answer_type",
        F.md5("context").alias("context_md5"),
        "question",
        "gold",
        F.md5("prompt").alias("prompt_md5"),
        "program",
        F.size("evidence").cast("long").alias("n_evidence"),
        F.col("metadata.raw_table_rows").cast("long").alias("raw_table_rows"),
        F.col("metadata.has_program").alias("has_program"),
        "error",
    )


def table_serialize(spark, d):
    return table(spark, d, "finqa_raw_sample").select("rec_no", norm.table_text(F.col("`table`")).alias("table_text"))


def infer_labels(spark, d):
    return _records(spark, d).select(
        "row_id",
        norm.answer_type(F.col("gold"), F.col("question")).alias("answer_type"),
        norm.subtype(F.col("question"), F.col("program"), F.col("gold")).alias("subtype"),
    )


def count_labels(spark, d):
    return _records(spark, d).groupBy("subtype", "answer_type").agg(F.count("*").alias("n"))


def gold_text(spark, d):
    return _records(spark, d).select("row_id", num.gold_text(F.col("gold"), F.col("answer_type")).alias("answer"))


def evidence_hint(spark, d):
    return _records(spark, d).select("row_id", prog.evidence_hint(F.col("evidence")).alias("hint"))


def answer_prompts(spark, d):
    m = prompts.answer_prompt(F.col("context"), F.col("question"), F.col("program"), True)
    return _records(spark, d).select("row_id", m[0]["content"].alias("system"), F.md5(m[1]["content"]).alias("user_md5"))


def answer_chat(spark, d):
    c = targets.answer_chat(_unique(_records(spark, d)), prefix="Final answer:")
    m = F.col("messages")
    return c.select(
        F.col("id").cast("long").alias("row_id"),
        F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
        F.md5(txt.text(m[1]["content"])).alias("user_md5"),
        m[2]["content"].alias("assistant"),
    )


def chat_validate(spark, d):
    r = _records(spark, d)
    c = r.select("row_id", norm.chat_messages(F.lit("s"), F.col("question"), txt.text(F.col("program"))).alias("messages"))
    return targets.check_chat(c).select("row_id", F.array_join("chat_errors", ",").alias("errors"))


# programs ------------------------------------------------------------------------


def program_operands(spark, d):
    o = prog.operand_lists(F.col("program"))
    return _records(spark, d).select(
        "row_id", F.array_join(o["source_numbers"], " ").alias("source_numbers"), F.array_join(o["constants"], " ").alias("constants")
    )


def program_op_counts(spark, d):
    return _records(spark, d).select(F.explode(prog.program_ops(F.col("program"))).alias("op")).groupBy("op").agg(F.count("*").alias("n"))


def program_runs(spark, d):
    r = _records(spark, d).select("row_id", prog.run_program(F.col("program")).alias("r"))
    return r.select("row_id", "r.answer", "r.trace", "r.steps", "r.error")


def program_extract(spark, d):
    reply = F.concat(F.lit("Plan first.\n```text\n"), F.replace(F.col("program"), F.lit(", "), F.lit(" ,  ")), F.lit("\n```\nDone (see above)."))
    return _records(spark, d).select("row_id", prog.extract_program_column(reply).alias("program"))


def calculator_exec(spark, d):
    """divide(subtract(price, quantity), quantity) of each line item, run as a program."""
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("divide(subtract("), price, F.lit(", "), quantity, F.lit("), "), quantity, F.lit(")"))
    rows = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    r = rows.select("l_orderkey", "l_linenumber", prog.run_program(text).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "r.answer")


def calculator_errors(spark, d):
    """Programs of orders that divide by zero, refer beyond their steps, or run."""
    kind = F.col("o_orderkey") % 3
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("divide("), total, F.lit(", const_0)"))).when(kind == 1, F.concat(F.lit("add("), total, F.lit(", #3)")))
    text = text.otherwise(F.concat(F.lit("greater("), total, F.lit(", const_150000)")))
    r = table(spark, d, "orders").select("o_orderkey", prog.run_program(text).alias("r"))
    return r.select("o_orderkey", "r.answer", F.substring_index("r.error", ":", 1).alias("error"))


def table_programs(spark, d):
    """The largest, smallest or summed quantity of each order, as a program over its lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("q"))
    op = F.element_at(F.array(*[F.lit(x) for x in ("table_max(", "table_min(", "table_sum(")]), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return lines.select("l_orderkey", prog.run_program(F.concat(op, F.array_join("q", ", "), F.lit(")")))["answer"].alias("answer"))


def calculator_ops(spark, d):
    """Powers, products, sums, comparisons and steps that refer to each other, over order keys."""
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("exp("), (F.col("o_orderkey") % 97).cast("string"), F.lit(", const_2)")))
    text = text.when(kind == 1, F.concat(F.lit("multiply("), k, F.lit(", 3)"))).when(kind == 2, F.concat(F.lit("add("), k, F.lit(", 5)")))
    text = text.when(kind == 3, F.concat(F.lit("greater("), k, F.lit(", 100)")))
    text = text.otherwise(F.concat(F.lit("add("), k, F.lit(", const_1), multiply(#0, 2), subtract(#1, 7)")))
    return table(spark, d, "orders").select("o_orderkey", prog.run_program(text)["answer"].alias("answer"))


def program_checks(spark, d):
    c = targets.validate_programs(_records(spark, d).select("row_id", "subtype", "program", "gold"))
    return c.select("row_id", "check.executable", "check.matches_gold", F.array_join(F.transform("check.errors", lambda e: F.substring_index(e, ":", 1)), ",").alias("errors"))


def program_report(spark, d):
    return targets.program_report(_unique(_records(spark, d).select("row_id", "subtype", "program", "gold")), "program")


def calculation_targets(spark, d):
    return targets.calculation_targets(_records(spark, d).select("row_id", "gold", "answer_type", "program", "evidence"))


def reasoning_targets(spark, d):
    c = targets.reasoning_targets(_records(spark, d).select("row_id", "gold", "answer_type", "program", "evidence"))
    return c.select("row_id", "assistant_content", "assistant_reasoning_content")


def program_targets(spark, d):
    t = targets.program_targets(_records(spark, d).select("row_id", "subtype", "gold", "program"))
    return t.select("row_id", "assistant_program", "calculator_answer", "calculator_trace", "program_step_count")


def source_targets(spark, d):
    r = _records(spark, d).select("row_id", "subtype", "gold", "answer_type", "question", "context", "program", "metadata")
    return targets.source_targets(r).select("row_id", "operation_class", "assistant_source_program")


def source_target_checks(spark, d):
    r = _records(spark, d).select("row_id", "subtype", "gold", "answer_type", "question", "context", "program", "metadata")
    c = targets.validate_source_targets(targets.source_targets(r))
    return c.select("row_id", F.array_join("source_errors", ",").alias("errors"))


# training sets -----------------------------------------------------------------------


def _sources(spark, d):
    """Records under their row number, subtypes in the spelling of the mixes."""
    kind = F.replace(category(F.col("subtype")), F.lit("multistep"), F.lit("multi_step"))
    return _unique(_records(spark, d)).withColumn("subtype", kind)


def _held_ids(spark, d):
    """Ids of the evaluation rows, which training sets leave out."""
    return _unique(_records(spark, d)).where(split_name(F.col("source_split")) != "train").select("id")


def _chosen(rows, *more):
    return rows.select(F.col("id").cast("long").alias("row_id"), "subtype", *more)


def calculation_set(spark, d):
    return _chosen(builders.calculation_set(_sources(spark, d), strict=False, key="row_id"), F.md5("assistant_target").alias("target_md5"))


def reasoning_set(spark, d):
    return _chosen(builders.reasoning_set(_sources(spark, d), strict=False, key="row_id"), "assistant_content")


def program_set(spark, d):
    return _chosen(builders.program_set(_sources(spark, d), exclude=_held_ids(spark, d), strict=False, key="row_id"), "assistant_program")


def targeted_set(spark, d):
    out = builders.targeted_set(_sources(spark, d), exclude=_held_ids(spark, d), strict=False, key="row_id")
    return _chosen(out, F.col("targeted_selection_bucket").alias("bucket"))


def source_set(spark, d):
    out = builders.source_set(_sources(spark, d), exclude=_held_ids(spark, d), strict=False, key="row_id")
    return _chosen(out, F.col("source_program_selection_bucket").alias("bucket"), "assistant_source_program")


def targeted_report(spark, d):
    built = targets.with_tags(targets.program_targets(_sources(spark, d)), "targeted_program_tags")
    return targets.program_report(built.withColumn("targeted_selection_bucket", F.get("targeted_program_tags", F.lit(0))))


def source_report(spark, d):
    return targets.source_report(targets.source_targets(_sources(spark, d)))


def _chat(chats):
    m = F.col("messages")
    return chats.select(F.col("id").cast("long").alias("row_id"), F.md5(m[1]["content"]).alias("user_md5"), m[2]["content"].alias("assistant"))


def calculation_chat(spark, d):
    return _chat(targets.calculation_chat(_unique(_records(spark, d))))


def reasoning_chat(spark, d):
    return _chat(targets.reasoning_chat(_unique(_records(spark, d))))


def program_chat(spark, d):
    return _chat(targets.program_chat(_unique(_records(spark, d)), True))


def source_chat(spark, d):
    return _chat(targets.source_chat(_unique(_records(spark, d)), True))


def chat_report(spark, d):
    return targets.chat_report(targets.answer_chat(_unique(_records(spark, d))), None, "id")


# answers ----------------------------------------------------------------------------


def final_answer_extract(spark, d):
    fa = txt.final_answer(F.col("tuned_answer"))
    return table(spark, d, "predictions").select("pred_no", fa["answer"].alias("answer"), fa["found"].alias("found"))


def format_violation(spark, d):
    return table(spark, d, "predictions").select("pred_no", (~txt.strict_format(F.col("tuned_answer"))).alias("violation"))


def abstention_flag(spark, d):
    return table(spark, d, "predictions").select(
        "pred_no", txt.contains_abstention(F.col("tuned_answer")).alias("tuned"), txt.contains_abstention(F.col("gold")).alias("gold_abstains")
    )


def normalize_text(spark, d):
    return table(spark, d, "predictions").select("pred_no", txt.normalize_answer(F.col("tuned_answer")).alias("answer"))


def offline_first_number(spark, d):
    return gen.generate(_records(spark, d).withColumn("id", F.col("row_id").cast("string")), "offline_first_number").select(
        F.col("id").cast("long").alias("row_id"), "prediction", "finish_reason"
    )


def offline_gold(spark, d):
    return gen.generate(_unique(_records(spark, d)), "offline_gold").select(F.col("id").cast("long").alias("row_id"), "prediction")


def offline_abstain(spark, d):
    out = gen.generate(_unique(_records(spark, d)), "offline_abstain")
    return out.select(F.col("id").cast("long").alias("row_id"), "prediction", "finish_reason")


def model_errors(spark, d):
    out = gen.model_error_row(_unique(_records(spark, d)), F.lit("timeout"), "http", "m")
    return out.select(F.col("id").cast("long").alias("row_id"), "prediction", "finish_reason")


def _asked(spark, d, source):
    p = gen.planner_prompts(_records(spark, d), source, True)
    return p.select("row_id", F.col("messages")[0]["content"].alias("system"), F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


def program_prompts(spark, d):
    return _asked(spark, d, False)


def source_prompts(spark, d):
    return _asked(spark, d, True)


def planned_programs(spark, d):
    """Planner replies made of the gold programs: fenced, bare, broken or absent by turns."""
    kind, program = F.col("row_id") % 4, F.coalesce("program", F.lit(""))
    reply = F.when(kind == 0, F.concat(F.lit("Plan:\n```\n"), program, F.lit("\n```"))).when(kind == 1, program)
    reply = reply.when(kind == 2, F.concat(F.lit("divide("), program, F.lit(", 0)"))).otherwise("I do not know.")
    out = gen.plan_programs(_unique(_records(spark, d)), reply, "offline", "gold")
    return out.select(F.col("id").cast("long").alias("row_id"), "predicted_program", "prediction", "finish_reason")


def finish_reasons(spark, d):
    return table(spark, d, "predictions").groupBy(F.coalesce("finish_reason", F.lit("(none)")).alias("finish_reason")).agg(F.count("*").alias("n"))


def oracle_planner(spark, d):
    return gen.oracle_predictions(_unique(_records(spark, d))).select(F.col("id").cast("long").alias("row_id"), "prediction", "finish_reason")


def _synthetic_run(spark, d):
    """Line items as predictions: a price, sometimes off by a known share, every second one without the marker."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    off = F.element_at(F.array(*[F.lit(x).cast("decimal(6,4)") for x in ("1.0000", "1.0004", "1.0020", "1.0500")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    said = (price * off).cast("decimal(18,2)").cast("string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return spread(rows).select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("subtype"),
        price.cast("string").alias("gold"),
        F.concat(F.when(F.col("l_orderkey") % 2 == 0, "Final answer: $").otherwise("It was $"), said).alias("prediction"),
        F.concat(F.lit("Price "), price.cast("string")).alias("context"),
    )


def numeric_match(spark, d):
    items = ev.score_items(_synthetic_run(spark, d), keep=("l_orderkey", "l_linenumber"))
    return items.select("l_orderkey", "l_linenumber", "extracted_answer", "format_violation", "correct", "hallucinated_figure")


def score_summary(spark, d):
    items = ev.score_items(_synthetic_run(spark, d), keep=("l_orderkey",))
    out = ev.summarize(items, intervals=False)
    return out.select(
        F.coalesce("subtype", F.lit("(all)")).alias("subtype"),
        "n",
        F.round("exact_match", 9).alias("exact_match"),
        F.round("format_violation_rate", 9).alias("format_violation_rate"),
        F.round("hallucinated_figure_rate", 9).alias("hallucinated_figure_rate"),
    )


def _scored(spark, d, column):
    p = table(spark, d, "predictions").withColumnRenamed(column, "prediction")
    return ev.score_items(p, keep=("id", "pred_no"))


def score_predictions(spark, d):
    p = ev.stack_runs(table(spark, d, "predictions"), {"base": "base_answer", "tuned": "tuned_answer"}, ["pred_no", "gold", "context", "subtype"])
    return ev.score_items(p, keep=("pred_no", "label")).drop("unsupported_numbers")


def score_predictions_summary(spark, d):
    p = ev.stack_runs(table(spark, d, "predictions"), {"base": "base_answer", "tuned": "tuned_answer"}, ["pred_no", "gold", "context", "subtype"])
    p = p.withColumn("subtype", category(F.col("subtype")))
    return ev.summarize(ev.score_items(p, keep=("pred_no", "label")), ("label",))


def compare_predictions(spark, d):
    return ev.compare_runs(_scored(spark, d, "base_answer"), _scored(spark, d, "tuned_answer"), "pred_no")


def failure_pack(spark, d):
    p = table(spark, d, "predictions").select("id", "pred_no", "question", "gold", "context")
    return ev.failure_pack(p, {"base": _scored(spark, d, "base_answer"), "tuned": _scored(spark, d, "tuned_answer")}, "base", "tuned", "pred_no").drop("context")


def judge_offline(spark, d):
    j = ev.judge(F.col("base_answer"), F.col("tuned_answer"), F.col("gold"), F.col("context"))
    return table(spark, d, "predictions").select("pred_no", j["winner"].alias("winner"), j["rationale"].alias("rationale"))


def answer_order(spark, d):
    o = sampling.answer_order(F.col("base_answer"), F.col("tuned_answer"), F.col("pred_no"))
    return table(spark, d, "predictions").select("pred_no", o["swapped"].alias("swapped"))


# statistics ------------------------------------------------------------------------------


def _flags(spark, d):
    return table(spark, d, "orders").select(
        "o_orderpriority", (F.col("o_totalprice") > 150000).alias("a"), (F.col("o_custkey") % 2 == 0).alias("b")
    )


def paired_compare(spark, d):
    return stats.paired_counts(_flags(spark, d), "a", "b", ["o_orderpriority"]).withColumn("delta", F.round("delta", 9))


def mcnemar(spark, d):
    return stats.mcnemar(_flags(spark, d), "a", "b", ["o_orderpriority"]).select("o_orderpriority", F.round("p_value", 9).alias("p_value"))


def cohen_kappa(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("b"))
    k = stats.kappa(rows, "a", "b")
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def bootstrap_ci(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") > 4000).cast("int").alias("v"))
    return stats.bootstrap_ci(s, "v", "s_suppkey").select("n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


# resuming and selecting ----------------------------------------------------------------------


def resume_pending(spark, d):
    r = _records(spark, d)
    held = r.where(split_name(F.col("source_split")).isin("dev", "test")).select("row_id", "id")
    return held.join(table(spark, d, "predictions").select("id").where("id is not null").distinct(), "id", "left_anti").select("row_id", "id")


def select_rows(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return ev.select_rows(orders, "id", 500, done)


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_NAMES = """tokenize_count distinct_ngrams ngram_overlap_pairs decontaminate_documents decontaminate_train decontaminate_kept
    stratified_split_members stratified_split_counts quota_sample target_tags operation_class tag_counts targeted_bucket_sample
    normalize_records table_serialize infer_labels count_labels gold_text evidence_hint answer_prompts answer_chat chat_validate
    program_operands program_op_counts program_runs program_extract calculator_exec calculator_errors program_checks program_report
    calculation_targets reasoning_targets program_targets source_targets source_target_checks final_answer_extract format_violation
    abstention_flag normalize_text offline_first_number offline_gold oracle_planner numeric_match score_summary score_predictions
    score_predictions_summary compare_predictions failure_pack judge_offline answer_order paired_compare mcnemar cohen_kappa
    bootstrap_ci resume_pending select_rows json_props calculation_set reasoning_set program_set targeted_set source_set
    targeted_report source_report calculation_chat reasoning_chat program_chat source_chat chat_report offline_abstain
    model_errors program_prompts source_prompts planned_programs finish_reasons table_programs calculator_ops""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
