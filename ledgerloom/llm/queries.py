"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import defects, leaks, mixing, overlap, quota, splits, subjects
from ledgerloom.session import table

RECORDS = "finqa_normalized_sample"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("row_id", "entity")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(table(spark, d, RECORDS), table(spark, d, "issuers"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("row_id", "entity", "split")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_split(spark, d))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: rows assigned, issuers in two splits, and whether sizes and category shares are near their targets."""
    rows = _split(spark, d)
    report = splits.split_report(rows)
    goal = F.create_map(*[F.lit(x) for p in splits.RATIOS.items() for x in p])
    split_rows = rows.where("entity is not null").groupBy("entity").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("issuers_in_two_splits"))
    near = report.agg(
        F.coalesce(F.bool_and(F.abs(F.col("split_share") - F.try_element_at(goal, F.col("split"))) <= 0.02), F.lit(True)).alias("sizes_near"),
        F.coalesce(F.bool_and(F.abs(F.col("category_share") - F.col("target_share")) <= 0.05), F.lit(True)).alias("categories_near"),
    )
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("split").isNull()).alias("without_split"))
    return total.crossJoin(split_rows).crossJoin(near)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.sample_to_targets(table(spark, d, RECORDS), table(spark, d, "sampling_targets"))
    return report.where("short").select("plan_id", "subtype", "answer_type")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    sample, report = quota.sample_to_targets(table(spark, d, RECORDS), table(spark, d, "sampling_targets"))
    names = report.select("plan_id", "cell_a", "cell_b", "subtype", "answer_type")
    return sample.join(F.broadcast(names), ["plan_id", "cell_a", "cell_b"]).select("plan_id", "row_id", "subtype", "answer_type")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.sample_to_targets(table(spark, d, RECORDS), table(spark, d, "sampling_targets"))
    return report.drop("cell_a", "cell_b")


def p2_margins(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.sample_to_targets(table(spark, d, RECORDS), table(spark, d, "sampling_targets"))
    return quota.margin_report(report)


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: categories, those whose sample differs from its quota, those under their floor, rows drawn twice."""
    sample, report = quota.sample_to_targets(table(spark, d, RECORDS), table(spark, d, "sampling_targets"))
    cell = ["plan_id", "cell_a", "cell_b"]
    drawn = sample.groupBy(*cell).agg(F.count("*").alias("drawn"), F.count_distinct("row_id").alias("different"))
    floors = table(spark, d, "sampling_targets").groupBy(F.col("plan_id").cast("long").alias("plan_id"), "subtype", "answer_type").agg(F.max("floor_rows").alias("floor"))
    both = report.join(drawn, cell, "left").fillna({"drawn": 0, "different": 0}).join(floors, ["plan_id", "subtype", "answer_type"])
    return both.groupBy("plan_id").agg(
        F.count("*").alias("categories"),
        F.count_if(F.col("drawn") != F.col("quota")).alias("off_quota"),
        F.count_if(F.col("drawn") < F.least("floor", "available")).alias("under_floor"),
        F.sum(F.col("drawn") - F.col("different")).alias("drawn_twice"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(table(spark, d, "predictions")).where("nth = 0").select("pred_no", "field", "defect")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_report(defects.broken_pairs(table(spark, d, "predictions")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, RECORDS))[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(overlap.cross_split_pairs(table(spark, d, RECORDS))[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents per held-out item, with its suite."""
    items = table(spark, d, "heldout_items").select("item_id", "suite")
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents")).join(items, "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that remain after removal."""
    docs = table(spark, d, "documents")
    return leaks.clean_documents(docs.select("doc_id"), _leaks(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where("short").select("mix_id", "source")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per mix: sources, those beyond their repeats, and those farther from their budget than one document."""
    docs = table(spark, d, "documents")
    selection, report = mixing.mix_sources(docs, table(spark, d, "mix_targets"))
    longest = selection.agg(F.max("tokens").alias("longest"))
    off = F.when(F.col("short"), F.col("given") != F.col("available") * F.col("max_repeats")).otherwise(F.abs(F.col("given") - F.col("wanted")) > F.col("longest"))
    return report.crossJoin(longest).groupBy("mix_id").agg(
        F.count("*").alias("sources"), F.count_if(F.col("most_repeats") > F.col("max_repeats")).alias("over_repeats"), F.count_if(off).alias("off_budget")
    )


def _areas(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return subjects.subject_areas(docs, subjects.fit(docs, table(spark, d, "subject_labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_areas(spark, d), table(spark, d, "documents"))


_ALL = (
    *(p1_found, p1_splits, p1_report, p1_checks),
    *(p2_found, p2_sample, p2_report, p2_margins, p2_checks),
    *(p4_found, p4_report),
    *(p5_found, p5_report),
    *(p7_found, p7_places, p7_items, p7_clean),
    *(p8_found, p8_selection, p8_report, p8_checks),
    *(p9_found, p9_composition),
)
QUERIES = {f.__name__: f for f in _ALL}
