"""Scores of prediction runs, paired comparison, failure pack, judge and offline providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import exact_match, extract_numbers, unsupported_numbers
from ledgerloom.functions.text import BARE_ABSTENTION, excerpt, final_answer, normalize_answer, squeeze, strict_format, text
from ledgerloom.operators.stats import binary_ci, exact_pvalue, paired_counts, rate


def score_items(
    rows: DataFrame,
    prediction: str = "prediction",
    gold: str = "gold",
    context: str = "context",
    subtype: str = "subtype",
    require_final_answer: bool = True,
    keep: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Per row: extracted answer, format violation, correctness, reason and unsupported figures.

    Null texts count as empty, a null subtype as ``unknown``.  Numbers of answer, gold and
    context are each parsed once, inside code generation.
    """
    said_final = final_answer(F.col(prediction))
    base = rows.select(
        *keep,
        F.coalesce(F.col(subtype), F.lit("unknown")).alias("subtype"),
        text(F.col(gold)).alias("gold"),
        text(F.col(prediction)).alias("prediction"),
        said_final["answer"].alias("extracted_answer"),
        said_final["found"].alias("has_final_answer"),
        (~(said_final["found"] & strict_format(F.col(prediction))) if require_final_answer else F.lit(False)).alias("format_violation"),
        extract_numbers(F.col(gold)).alias("_gold"),
        extract_numbers(F.col(context)).alias("_known"),
    )
    base = base.withColumn("_said", extract_numbers(F.col("extracted_answer")))
    match = exact_match(F.col("extracted_answer"), F.col("gold"), F.col("_said"), F.col("_gold"))
    loose = unsupported_numbers(F.col("_said"), F.concat("_known", "_gold"))
    scored = base.withColumn("_match", match).withColumn("unsupported_numbers", F.transform(loose, lambda n: n["surface"]))
    return scored.select(
        *keep,
        "subtype",
        "gold",
        "prediction",
        "extracted_answer",
        "has_final_answer",
        "format_violation",
        (F.col("_match.is_match") & ~F.col("format_violation")).alias("correct"),
        F.col("_match.reason").alias("match_reason"),
        (F.size("unsupported_numbers") > 0).alias("hallucinated_figure"),
        "unsupported_numbers",
    )


def stack_runs(rows: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per run of a wide table: (keep..., label, prediction)."""
    runs = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("prediction")) for k, c in columns.items()])
    return rows.select(*keep, F.explode(runs).alias("r")).select(*keep, "r.label", "r.prediction")


def summarize(items: DataFrame, by: tuple[str, ...] = (), intervals: bool = True) -> DataFrame:
    """Rates per group and per subtype within it (a null subtype is the whole group), in one pass."""
    cols = [*by, "subtype"]
    sets = [[F.col(c) for c in by] + [F.col("subtype")], [F.col(c) for c in by]]
    agg = items.groupingSets(sets, *cols).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("hits"),
        rate(F.col("correct")).alias("exact_match"),
        rate(F.col("format_violation")).alias("format_violation_rate"),
        rate(F.col("hallucinated_figure")).alias("hallucinated_figure_rate"),
        F.grouping("subtype").alias("overall"),
    )
    if intervals:
        agg = agg.withColumn("ci", binary_ci(F.col("n"), F.col("hits"))).withColumns({"ci_low": F.col("ci.low"), "ci_high": F.col("ci.high")}).drop("ci")
    return agg.drop("hits")


def last_by_id(items: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The last row of each id; the rows of one id are compared map-side before any shuffle."""
    struct = F.struct(*[F.col(c) for c in items.columns])
    return items.groupBy(F.col(key).alias("_k")).agg(F.max_by(struct, F.col(order)).alias("s")).select("s.*")


def compare_runs(baseline: DataFrame, candidate: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row: paired rows, difference of correctness with interval, exact p-value.  Duplicate ids: the last wins."""
    a = last_by_id(baseline.select(key, order, F.col("correct").alias("a")), order, key)
    b = last_by_id(candidate.select(key, order, F.col("correct").alias("b")), order, key)
    counts = paired_counts(a.select(key, "a").join(b.select(key, "b"), key), "a", "b")
    ci = binary_ci(F.col("n"), F.col("only_b"), F.col("only_a"))
    return counts.select(
        F.col("n").alias("n_paired"),
        F.col("delta").alias("paired_delta"),
        ci["low"].alias("delta_low"),
        ci["high"].alias("delta_high"),
        exact_pvalue(F.col("only_a"), F.col("only_b")).alias("p_value"),
    )


def failure_pack(
    records: DataFrame, runs: dict[str, DataFrame], old: str, new: str, order: str, key: str = "id"
) -> DataFrame:
    """Triage rows of ids that all scored ``runs`` and ``records`` have, with the change from ``old`` to ``new``.

    ``runs`` maps labels to scored items; ``order`` orders duplicates of an id in runs and
    records, the last wins.  Sorted by priority and id.
    """
    out = last_by_id(records, order, key)
    for label, items in runs.items():
        mine = last_by_id(items, order, key).select(
            key,
            squeeze(text(F.col("prediction"))).alias(f"{label}_prediction"),
            F.col("extracted_answer").alias(f"{label}_extracted"),
            F.col("correct").alias(f"{label}_correct"),
            F.col("hallucinated_figure").alias(f"{label}_hallucinated"),
            F.to_json("unsupported_numbers").alias(f"{label}_unsupported_numbers"),
        )
        out = out.join(mine, key)
    was, now = F.col(f"{old}_correct"), F.col(f"{new}_correct")
    loose, looser = F.col(f"{old}_hallucinated"), F.col(f"{new}_hallucinated")
    said = F.col(f"{new}_extracted")
    transition = F.when(was & now, "both_correct").when(now, "fixed").when(was, "regressed").otherwise("both_wrong")
    shift = (
        F.when(~loose & looser, "new_unsupported")
        .when(loose & looser, "persistent_unsupported")
        .when(loose, "resolved_unsupported")
        .otherwise("none_unsupported")
    )
    label = (
        F.when(now, "correct")
        .when(was, "exact_match_regression")
        .when(~loose & looser, "new_unsupported_figure")
        .when(looser, "unsupported_figure")
        .when(said.rlike(BARE_ABSTENTION) | said.rlike(r"(?iU)\binsufficient\b"), "unsupported_abstention")
        .otherwise("wrong_supported_or_computed_number")
    )
    rank = (
        F.when(was & ~now, 1)
        .when(~loose & looser, 2)
        .when(looser, 3)
        .when(F.lower(said).startswith("not enough information"), 4)
        .otherwise(5)
    )
    marked = out.withColumns(
        {
            "priority_rank": rank,
            "priority": F.when(rank <= 3, "yes").otherwise("no"),
            "transition": transition,
            "unsupported_shift": shift,
            "suggested_label": label,
            "human_label": F.lit(""),
            "human_notes": F.lit(""),
            "context_excerpt": excerpt(F.col("context")),
        }
    )
    return marked.orderBy("priority_rank", key)


def judge(a: Column, b: Column, gold: Column, context: Column) -> Column:
    """Struct (winner, rationale): the answer that matches the gold, else the one with fewer unsupported figures, else a tie."""
    want, known = extract_numbers(gold), extract_numbers(context)
    na, nb = extract_numbers(a), extract_numbers(b)
    hit_a, hit_b = exact_match(a, gold, na, want)["is_match"], exact_match(b, gold, nb, want)["is_match"]
    loose_a = F.size(unsupported_numbers(na, F.concat(known, want)))
    loose_b = F.size(unsupported_numbers(nb, F.concat(known, want)))
    winner = F.when(hit_a != hit_b, F.when(hit_a, "a").otherwise("b")).when(loose_a < loose_b, "a").when(loose_b < loose_a, "b").otherwise("tie")
    reason = F.when(hit_a != hit_b, "gold matched").when(loose_a != loose_b, "fewer unsupported figures").otherwise("equivalent")
    return F.struct(winner.alias("winner"), reason.alias("rationale"))


def agreement(a: Column, b: Column) -> Column:
    """Normalised texts are equal."""
    return normalize_answer(a) == normalize_answer(b)


def pivot_report(summary: DataFrame, label: str = "label") -> DataFrame:
    """Exact-match rates: one row per run, one column per subtype."""
    return summary.where("overall = 0").groupBy(label).pivot("subtype").agg(F.first("exact_match"))


def first_present(rows: DataFrame, column: str, order: str, default: str = "unknown") -> DataFrame:
    """One row: the first value that is neither null nor empty, in row order."""
    c = F.when(F.col(column).cast("string") != "", F.col(column).cast("string"))
    return rows.agg(F.coalesce(F.min_by(c, F.when(c.isNotNull(), F.col(order))), F.lit(default)).alias(column))


def select_rows(rows: DataFrame, order: str, limit: int | None = None, exclude: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Exclude ids, then keep the first ``limit`` rows in order."""
    out = rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")
    return out if limit is None else out.orderBy(order).limit(limit)


