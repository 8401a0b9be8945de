"""Mixtures of sources by token budget, drawn by hash thresholds.

Tokens are summed by source and hash bucket.  For each mix and source the buckets
below a budget are taken whole; only the boundary bucket is summed again by finer
bits of the same hash, twice, so that the threshold is exact to a few documents.
The selection is then a filter on hash and threshold: nothing is sorted, and the
budgets of all mixes on a source are nested prefixes of one hash order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import letters
from ledgerloom.session import cut, small

#: Ranks of the public byte-pair vocabulary that sizes are counted in.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits of the hash per level, and levels: 2**36 positions in all.
BITS, LEVELS = 12, 3
# Fixed value: how the vocabulary splits text before merging (public GPT-2 pattern).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([0 if not t else len(encode(t)) for t in texts], dtype="int64")

    return run


def token_count(c: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""
    return F.pandas_udf(_counter(tokenizer), "long")(c)


def sized_documents(documents: DataFrame, key: str = "doc_id", seed: int = 13, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source_key, tokens, position): ``position`` is the place in the hash order, 0 to 2**36 - 1."""
    span = 1 << (BITS * LEVELS)
    return documents.select(
        key,
        letters(F.col("source")).alias("source_key"),
        token_count(F.col("text"), tokenizer).alias("tokens"),
        F.pmod(F.xxhash64(F.lit(seed), key), F.lit(span)).alias("position"),
    )


def mix_plan(targets: DataFrame, by_source: DataFrame, total: int) -> DataFrame:
    """Per mix and source: wanted tokens, available tokens, whole repeats, the budget of the last partial one, shortfall.

    ``by_source`` has source_key, available and docs.  A source falls short where its
    tokens times ``max_repeats`` are fewer than its share of the mix; it is then used
    ``max_repeats`` times throughout.  Targets with a null mix, source or share are
    ignored, repeated ones add up; null or negative repeats count as none.
    """
    want = (
        targets.where("mix_id is not null and source is not null and target_share is not null and total_frac is not null")
        .withColumn("source_key", letters(F.col("source")))
        .groupBy("mix_id", "source_key")
        .agg(
            F.min("source").alias("source"),
            F.sum("target_share").alias("target_share"),
            F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
            F.max("total_frac").alias("total_frac"),
        )
        .where("source_key is not null")
    )
    got = want.join(small(by_source), "source_key", "left").fillna({"available": 0, "docs": 0})
    budget = F.col("target_share") * F.col("total_frac") * F.lit(float(total))
    plan = got.select(
        F.col("mix_id").cast("long").alias("mix_id"),
        "source",
        "source_key",
        "target_share",
        "max_repeats",
        F.round(budget, 6).alias("wanted"),
        "available",
    )
    most = F.col("available") * F.col("max_repeats")
    plan = plan.withColumn("short", most < F.col("wanted"))
    whole = F.when(F.col("short") | (F.col("available") == 0), F.col("max_repeats")).otherwise(
        F.floor(F.col("wanted") / F.greatest("available", F.lit(1)))
    )
    plan = plan.withColumn("whole", whole.cast("long"))
    rest = F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("wanted") - F.col("whole") * F.col("available"))
    return plan.withColumn("rest", F.greatest(rest, F.lit(0.0)))


def _thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_id, source_key, threshold): documents below it come nearest to the budget ``rest`` from below or by half a document.

    Level by level: sum tokens by bucket, find the bucket in which the budget ends, and
    look only into that bucket at the next level.
    """
    span = BITS * LEVELS
    at = plan.where("rest > 0").select("mix_id", "source_key", "rest", F.lit(0).cast("long").alias("prefix"))
    at = cut(at)
    for level in range(1, LEVELS + 1):
        shift = span - BITS * level
        bucket = F.shiftright("position", shift)
        if level == 1:
            hist = sized.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"))
            here = small(at).join(hist, "source_key")
        else:
            within = at.select("source_key", "prefix").distinct()
            hist = (
                sized.withColumn("prefix", F.shiftright("position", shift + BITS))
                .join(small(within), ["source_key", "prefix"])
                .groupBy("source_key", "prefix", bucket.alias("bucket"))
                .agg(F.sum("tokens").alias("n"))
            )
            here = small(at).join(hist, ["source_key", "prefix"])
        w = Window.partitionBy("mix_id", "source_key").orderBy("bucket")
        placed = here.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
        edge = placed.where("before <= rest and upto > rest").select(
            "mix_id", "source_key", (F.col("rest") - F.col("before")).alias("left"), "bucket", F.col("n").alias("size")
        )
        # a budget that ends exactly with the last bucket takes everything seen at this level
        nxt = at.join(small(edge), ["mix_id", "source_key"], "left").select(
            "mix_id",
            "source_key",
            F.coalesce("left", F.lit(0.0)).alias("rest"),
            F.coalesce("bucket", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
            "size",
        )
        at = cut(nxt)
        if level < LEVELS:
            at = at.drop("size")
    # the last boundary position goes in if that lands nearer to the budget
    step = F.when(F.col("rest") * 2 > F.coalesce("size", F.lit(0)), 1).otherwise(0)
    return at.select("mix_id", "source_key", (F.col("prefix") + step).alias("threshold"))


def mix_sources(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 13, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of ``documents`` for every mix of ``targets``.

    The selection has mix_id, key, source_key, tokens and repeats (how often the document
    is used, at most ``max_repeats``); the report has the plan per source with the tokens
    actually given, their share of the mix, and whether the source falls short.
    Documents with a null source count only in the total; empty texts have no tokens and
    go wherever their hash falls.  An empty table leaves every source short.
    """
    sized = cut(sized_documents(documents, key, seed, tokenizer))
    by = cut(sized.groupBy("source_key").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs")))
    total = by.agg(F.sum("available")).first()[0] or 0
    plan = cut(mix_plan(targets, by.where("source_key is not null"), total))
    limits = _thresholds(sized.where("source_key is not null"), plan)
    used = small(plan.join(small(limits), ["mix_id", "source_key"], "left").select("mix_id", "source_key", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")))
    repeats = F.col("whole") + F.when(F.col("position") < F.col("threshold"), 1).otherwise(0)
    selection = (
        sized.join(used, "source_key")
        .withColumn("repeats", repeats)
        .where("repeats > 0")
        .select("mix_id", key, "source_key", "tokens", "repeats")
    )
    given = selection.groupBy("mix_id", "source_key").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("given"), F.max("repeats").alias("most_repeats")
    )
    report = plan.join(given, ["mix_id", "source_key"], "left").fillna({"given": 0, "most_repeats": 0})
    of_mix = F.sum("given").over(Window.partitionBy("mix_id"))
    report = report.select(
        "mix_id",
        "source",
        "target_share",
        "max_repeats",
        "wanted",
        "available",
        "given",
        "most_repeats",
        F.round(F.col("given") / F.nullif(of_mix, F.lit(0)), 9).alias("actual_share"),
        "short",
    )
    return selection, report
