"""Training rows that repeat protected rows, by containment of n-grams.

Overlap is the share of a candidate's distinct n-grams that a protected item has.  The
n-grams of protected rows are first put into classes, all n-grams that the same items
have being one: a page that many protected rows quote is one class, however many n-grams
and rows it has.  Candidates meet the protected n-grams once (where they are read, if those
are few), and only counts per candidate and class go on.

Items are then counted per candidate where its classes are, with the items of the classes
as plain arrays.  These pass in blocks of items of a fixed size, so that neither the driver
nor a task holds more than a block, however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import let, ngram_hashes, tokens
from ledgerloom.session import cut, measured, small, spread

#: Bytes of protected n-grams up to which they are broadcast, and of a block of (class, item).
SIDE_BYTES, BLOCK_BYTES = 16 << 20, 64 << 20
#: Items of a candidate's classes that are added up at once; beyond, frequent classes are searched for the items of the others.
GATHER = 50_000


def protected_classes(protected: DataFrame, item: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(grams, members): (g, cls) of each n-gram and (cls, item) of each class."""
    grams = ngram_hashes(tokens(F.col(text)), n)
    p = spread(protected.select(F.col(item).alias("item"), F.col(text))).select("item", F.explode(grams).alias("g"))
    same = Window.partitionBy("g")
    named = F.xxhash64(F.col("item").cast("string"))
    cls = F.xxhash64(F.count("*").over(same), F.bit_xor(named).over(same), F.bit_xor(F.xxhash64(F.lit(1), F.col("item").cast("string"))).over(same))
    # one shuffle, by n-gram, serves to merge equal items and to put n-grams into classes
    p = cut(p.repartition("g").distinct().select("g", "item", cls.alias("cls")))
    return p.groupBy("g").agg(F.min("cls").alias("cls")), cut(p.select("cls", "item").distinct())


class Block:
    """The items of the classes, as arrays, of some items."""

    def __init__(self, members: pa.Table):
        cls, item = members["cls"].to_numpy(), members["item"].combine_chunks().dictionary_encode()
        if isinstance(item, pa.ChunkedArray):
            item = item.combine_chunks()
        self.names, codes = item.dictionary, item.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((codes, cls))
        self.items = codes[order]
        self.cls, self.start, self.size = np.unique(cls[order], return_index=True, return_counts=True)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The items of several classes, one after the other."""
        size = self.size[at]
        return self.items[np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _summed(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of the classes and the sums of ``n`` over the classes that have them."""
        items, weights = self._gather(at), np.repeat(n, self.size[at])
        if len(items) * 8 < len(self.names):
            items, inverse = np.unique(items, return_inverse=True)
            return items, np.bincount(inverse, weights)
        sums = np.bincount(items, weights)
        return (found := np.flatnonzero(sums)), sums[found]

    def shared(self, at: np.ndarray, n: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that share at least ``need`` n-grams with a candidate that has ``n`` of each of the classes ``at``."""
        order = np.argsort(self.size[at], kind="stable")
        at, n = at[order], n[order]
        rest = np.cumsum(n[::-1])[::-1]
        # the most frequent classes, together short of the need, find no items
        head = int((rest >= need).sum())
        found, cost = self.size[at[:head]].sum(), self.size[at].sum()
        if cost <= 4 * found + GATHER:
            head = len(at)
        items, sums = self._summed(at[:head], n[:head])
        for k in range(head, len(at)):
            keep = sums + rest[k] >= need
            items, sums = items[keep], sums[keep]
            own = self.items[self.start[at[k]] : self.start[at[k]] + self.size[at[k]]]
            place = np.searchsorted(own, items)
            sums = sums + n[k] * (own[np.minimum(place, len(own) - 1)] == items)
        keep = sums >= need
        return items[keep], sums[keep]


def _pairs(by_key: DataFrame, members: DataFrame, out: T.StructType) -> DataFrame:
    """Pairs (key, size, item, shared) that reach ``need`` within one block of ``members``, counted now so that the block can go."""
    told = by_key.sparkSession.sparkContext.broadcast(members.select("cls", "item").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block(told.value)
            if not len(block.cls):
                return
            met = batch["met"].flatten()
            cls, n = met.field("cls").to_numpy(), met.field("n").to_numpy()
            at = np.minimum(np.searchsorted(block.cls, cls), len(block.cls) - 1)
            known = block.cls[at] == cls
            ends = np.cumsum(batch["met"].value_lengths().to_numpy(zero_copy_only=False))
            rows, items, sums, begin = [], [], [], 0
            for row, (end, need) in enumerate(zip(ends, batch["need"].to_numpy())):
                own = known[begin:end]
                a, c = at[begin:end][own], n[begin:end][own]
                begin = end
                if c.sum() >= need:
                    i, s = block.shared(a, c, need)
                    rows.append(np.full(len(i), row))
                    items.append(i)
                    sums.append(s)
            if rows:
                where = pa.array(np.concatenate(rows))
                columns = [batch["key"].take(where), batch["size"].take(where), block.names.take(pa.array(np.concatenate(items))), pa.array(np.concatenate(sums).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    pairs = cut(by_key.mapInArrow(run, out))
    told.destroy()
    return pairs


def overlaps(
    candidates: DataFrame,
    protected: DataFrame,
    key: str,
    text: str,
    item: str,
    item_text: str,
    n: int = 13,
    threshold: float = 0.0,
) -> DataFrame:
    """(key, item, shared, size, overlap) of all pairs that share n-grams and reach ``threshold``.

    Protected rows with the same item are merged.  Candidates are told apart by ``key``,
    which must be unique.
    """
    known, members = protected_classes(protected, item, item_text, n)
    rows = spread(candidates.select(F.col(key).alias("key"), F.col(text).alias("_text")))
    # the size goes with each n-gram, so that the n-grams are made once
    sized = let(ngram_hashes(tokens(F.col("_text")), n), lambda a: F.transform(a, lambda g: F.struct(F.size(a).alias("size"), g.alias("g"))))
    probe = rows.select("key", F.inline(sized))
    hits = probe.join(small(known, size=SIDE_BYTES), "g").select("key", "size", "cls")
    if threshold > 0:
        need = F.greatest(F.ceil(F.lit(float(threshold)) * F.col("size") - F.lit(1e-9)), F.lit(1).cast("long"))
        hits = hits.repartition("key").groupBy("key", "size", "cls").agg(F.count("*").alias("n"))
        by_key = hits.groupBy("key", "size").agg(F.collect_list(F.struct("cls", "n")).alias("met"), F.sum("n").alias("total"))
        by_key = cut(by_key.withColumn("need", need).where("total >= need").drop("total"))
        members = members.where("item is not null")
        blocks = max(1, ceil(measured(members)[1] / BLOCK_BYTES))
        kinds = {f.name: f.dataType for f in [*by_key.schema, *members.schema]} | {"shared": T.IntegerType()}
        form = T.StructType([T.StructField(c, kinds[c]) for c in ("key", "size", "item", "shared")])
        part = F.pmod(F.xxhash64("item"), F.lit(blocks))
        out = None
        for b in range(blocks):
            more = _pairs(by_key, members.where(part == b), form)
            out = more if out is None else out.union(more)
    else:
        hits = hits.groupBy("key", "size", "cls").agg(F.count("*").alias("n"))
        out = hits.join(small(members, size=SIDE_BYTES), "cls").groupBy("key", "item").agg(F.sum("n").cast("int").alias("shared"), F.first("size").alias("size"))
    out = out.select("key", "item", "shared", "size", (F.col("shared") / F.col("size")).alias("overlap"))
    return out.where(F.col("overlap") >= threshold)


def decontaminate(
    candidates: DataFrame,
    protected: DataFrame,
    key: str,
    text: str,
    item: str,
    item_text: str,
    n: int = 13,
    threshold: float = 0.2,
) -> DataFrame:
    """(key, removed, max_overlap, matched_item) of every candidate.

    The item of the largest overlap is reported, the smallest one on a tie.  Texts of fewer
    than ``n`` tokens overlap nothing and are kept; with a threshold of 0 or less every
    candidate is removed, those without any overlap with the item ``none``.
    """
    pairs = overlaps(candidates, protected, key, text, item, item_text, n, threshold)
    top = pairs.groupBy("key").agg(F.max("overlap").alias("max_overlap"), F.min_by("item", F.struct(-F.col("overlap"), "item")).alias("best"))
    all_ = candidates.select(F.col(key).alias("key"))
    joined = all_.join(top, "key", "left")
    found = F.coalesce("max_overlap", F.lit(0.0))
    removed = F.col("max_overlap").isNotNull() if threshold > 0 else F.lit(True)
    return joined.select(
        F.col("key").alias(key),
        removed.alias("removed"),
        F.round(found, 9).alias("max_overlap"),
        F.when(removed, F.coalesce(F.col("best").cast("string"), F.lit("none"))).alias("matched_item"),
    )


def ngram_overlap(left, right, n: int = 13):
    """Share of the distinct n-grams of one text that another has; 0 where either has none."""
    a, b = ngram_hashes(tokens(left), n), ngram_hashes(tokens(right), n)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))
