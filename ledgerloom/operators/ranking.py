"""Ranks within groups without sorting whole groups.

Rows carry a random-looking hex key.  A histogram of key prefixes per group gives each
row's rank up to its bucket; only rows of buckets in which a boundary falls are ranked
among themselves.  A group that holds a third of all rows is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut, small

#: Hex digits of the bucket: 4096 buckets per group.
PREFIX = 3


def random_key(seed: int, *columns: str | Column) -> Column:
    """Hex digest of seed and key columns, the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def label_by_rank(df: DataFrame, groups: list[str], key: str, tie: str, bounds: DataFrame, label: str) -> DataFrame:
    """``df`` with a column ``label``: the label of the first bound that the row's rank does not exceed.

    ``bounds`` has the group columns, ``upto`` (BIGINT) and ``label``; rows beyond the last
    bound of their group, and rows of groups without bounds, are left out.  Ranks start at
    1 and follow ``key``, then ``tie``.  Null groups are a group of their own.
    """
    keyed = df.withColumn("_bucket", F.substring(F.col(key), 1, PREFIX))
    hist = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket"))
    hist = hist.withColumn("_last", upto).withColumn("_before", F.col("_last") - F.col("_n"))
    marks = bounds.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("upto", F.col(label).alias("label")))).alias("_marks"))
    eq = [F.col(f"h.{g}").eqNullSafe(F.col(f"m.{g}")) for g in groups]
    placed = (
        hist.alias("h")
        .join(small(marks).alias("m"), eq)
        .select(*[F.col(f"h.{g}").alias(g) for g in groups], "_bucket", "_before", "_last", "_marks")
        .where(F.col("_before") < F.element_at("_marks", -1)["upto"])
        .withColumn("_split", F.exists("_marks", lambda m: (m["upto"] > F.col("_before")) & (m["upto"] < F.col("_last"))))
    )
    on = [F.col(f"k.{g}").eqNullSafe(F.col(f"p.{g}")) for g in groups] + [F.col("k._bucket") == F.col("p._bucket")]
    cols = [F.col(f"k.`{c}`") for c in df.columns]
    joined = keyed.alias("k").join(small(placed).alias("p"), on).select(*cols, "k._bucket", "_before", "_marks", "_split")
    first = lambda rank: F.get(F.filter("_marks", lambda m: m["upto"] >= rank), F.lit(0))["label"]
    whole = joined.where("not _split").withColumn(label, first(F.col("_before") + 1))
    order = Window.partitionBy(*groups, "_bucket").orderBy(key, tie)
    edge = joined.where("_split").withColumn(label, first(F.col("_before") + F.row_number().over(order)))
    out = [*df.columns, label]
    return whole.select(*out).union(edge.select(*out)).where(F.col(label).isNotNull())


def row_numbers(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with its place, from 0, in the order of a unique column; no task sees more than a range of it."""
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + inside - 1).drop("_part", "_before")
