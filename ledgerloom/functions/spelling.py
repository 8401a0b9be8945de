"""Corpus-wide spelling repair by symmetric deletion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.strings import deletions, edits

#: A word is a misspelling of another that occurs at least so many times as often, in rows or in different texts.
RATIO = 20
#: Words from this length on may differ in two places, shorter ones in one.
LONG = 7
#: Words from this length on may differ in two places from one that is so many times as frequent.
FAIR, MUCH = 5, 200


def reach(usual: str, n: int, m: int) -> int:
    """Edits that may lie between a word seen ``n`` times and its usual form seen ``m`` times."""
    return 2 if len(usual) >= LONG or len(usual) >= FAIR and m >= MUCH * n else 1


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (d, w, n, t)
            for w, n, t in zip(pdf["word"], pdf["n"], pdf["texts"])
            for d in deletions(w, 2 if len(w) >= FAIR - 1 else 1)
        ]
        yield pd.DataFrame(rows, columns=["part", "word", "n", "texts"])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = zip(pdf["usual"], pdf["n"], pdf["m"], pdf["texts"], pdf["usual_texts"])
        most = [max(reach(c, n, m), reach(c, t, u)) for c, n, m, t, u in seen]
        d = [edits(w, c, k) for w, c, k in zip(pdf["word"], pdf["usual"], most)]
        yield pdf.assign(d=d)[[x <= m for x, m in zip(d, most)]][["word", "usual", "m", "d"]]


def repairs(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, usual): misspelt words with their usual form.

    ``words`` has one row per word of each different text: ``word``, and ``n``, the rows
    that have the text.  The ratio holds in rows or in different texts, so copies of a
    misspelt text don't make its words look usual.  Words of under four letters and words
    with digits are left alone.  Every rare word meets the words that share a deletion
    with it; the nearest wins, then the most frequent, then the first in order.
    """
    counts = (
        words.where(F.col("word").rlike(r"^[\p{L}'-]{4,}$"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    )
    parts = counts.mapInPandas(_expand, "part string, word string, n long, texts long")
    # rare forms against words that are frequent enough to be anyone's usual form
    usual = parts.where(f"n >= {ratio}").select(
        "part", F.col("word").alias("usual"), F.col("n").alias("m"), F.col("texts").alias("usual_texts")
    )
    often = (F.col("m") >= ratio * F.col("n")) | (F.col("usual_texts") >= ratio * F.col("texts"))
    pairs = (
        parts.join(usual, "part")
        .where(often & (F.col("word") != F.col("usual")))
        .select("word", "usual", "n", "m", "texts", "usual_texts")
        .distinct()
        .mapInPandas(_verify, "word string, usual string, m long, d int")
    )
    best = Window.partitionBy("word").orderBy("d", F.desc("m"), "usual")
    return pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("word", "usual")


def split_words(c: Column) -> Column:
    """Lower-case words of a text, hyphens and apostrophes inside a word kept."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, "[’‘]", "'")), F.lit(r"(?U)[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), 0)
