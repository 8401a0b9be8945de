"""Records of evaluation splits that occur again in the training split.

Questions are canonicalised and hashed; the hashes of dev and test rows are joined with
those of train rows.  The plain form removes case, punctuation and spacing; the canonical
one also framing phrases, unit requests, misspellings and the wording of the template.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import spelling
from ledgerloom.functions.labels import split_name
from ledgerloom.functions.questions import canonical
from ledgerloom.session import cut


#: Misspelt words that every task is told beforehand; more are joined to the rows that have them.
TOLD_ROWS, TOLD_BYTES = 200_000, 16 << 20

_CANON = "row_id long, split string, dataset string, plain long, canon string"


def _canonicalise(told):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = told.value if told is not None else None
        for pdf in batches:
            if usual is not None:
                canon = [canonical(q, usual) for q in pdf["question"]]
            else:
                canon = [canonical(q, dict(f) if f is not None and len(f) else None) for q, f in zip(pdf["question"], pdf["fixes"])]
            yield pdf[["row_id", "split", "dataset", "plain"]].assign(canon=canon)

    return run


def canonical_questions(records: DataFrame, ratio: int = spelling.RATIO) -> DataFrame:
    """(row_id, split, dataset, plain, canon, hash) of every record; plain and canon are null for blank questions."""
    spoken = spelling.split_words(F.col("question"))
    base = records.select("row_id", split_name(F.col("source_split")).alias("split"), "dataset", "question", spoken.alias("words"))
    # copies of a question, whatever their case and punctuation, count as one text
    texts = base.groupBy("words").agg(F.count("*").alias("n"))
    wrong = cut(spelling.repairs(texts.select(F.explode(F.array_distinct("words")).alias("word"), "n"), ratio))
    n, size = wrong.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("usual")), F.lit(0))).first()
    base = base.withColumn("plain", F.when(F.size("words") > 0, F.xxhash64(F.array_join("words", " "))))
    if n <= TOLD_ROWS and size <= TOLD_BYTES:
        told = records.sparkSession.sparkContext.broadcast({r.word: r.usual for r in wrong.collect()})
        out = base.drop("words").mapInPandas(_canonicalise(told), _CANON)
    else:
        tokens = base.select("row_id", F.explode(F.array_distinct("words")).alias("word"))
        fixes = tokens.join(wrong, "word").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "usual"))).alias("fixes"))
        out = base.drop("words").join(fixes, "row_id", "left").mapInPandas(_canonicalise(None), _CANON)
    return out.withColumn("hash", F.xxhash64("canon"))


def cross_split_pairs(records: DataFrame, ratio: int = spelling.RATIO) -> tuple[DataFrame, DataFrame]:
    """(pairs, canonical records): all (row_id_a, row_id_b) of a train and a dev or test row with one question.

    The smaller row_id comes first; row_id is unique, so pairs are distinct.  Rows with a null
    split or a blank question are in no pair; repeated rows count under their own row_id.
    """
    canon = cut(canonical_questions(records, ratio))
    asked = canon.where("canon is not null and split is not null")
    train = asked.where("split = 'train'").select("hash", "canon", F.col("row_id").alias("t"))
    held = asked.where("split <> 'train'").select("hash", "canon", F.col("row_id").alias("e"))
    pairs = held.join(train, ["hash", "canon"]).select(
        F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b")
    )
    return pairs, canon


def overlap_report(canon: DataFrame) -> DataFrame:
    """Per evaluation split and dataset: rows, rows seen in train (plainly, or in any wording), and pairs.

    Counts are made per question hash before the join, so a question that many rows
    share costs one row per split, dataset and plain form.
    """
    asked = canon.where("split is not null")
    held = (
        asked.where("split <> 'train'")
        .groupBy("split", "dataset", "plain", "hash", "canon")
        .agg(F.count("*").alias("n"))
    )
    seen = asked.where("split = 'train' and canon is not null")
    train = seen.groupBy("hash", "canon").agg(F.count("*").alias("m"))
    same = seen.select("plain", F.lit(True).alias("same")).distinct()
    rows = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return (
        held.join(train, ["hash", "canon"], "left")
        .join(same, "plain", "left")
        .groupBy("split", "dataset")
        .agg(
            F.sum("n").alias("eval_rows"),
            rows(F.col("same").isNotNull()).alias("plain_rows"),
            rows(F.col("m").isNotNull()).alias("leaked_rows"),
            F.sum(F.coalesce(F.col("n") * F.col("m"), F.lit(0))).alias("pairs"),
        )
    )
