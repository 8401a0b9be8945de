"""Incremental scoring and appending of predictions with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.evaluate import score_items


def resume(source: DataFrame, output: str, checkpoint: str, key: str = "id", transform=None) -> StreamingQuery:
    """Append the rows of a stream to ``output`` as Parquet, each key once, over restarts too.

    A batch that is repeated after a failure finds its rows in the output and appends
    nothing; keys repeated within a batch are written once.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        out = transform(batch) if transform else batch
        out = out.dropDuplicates([key])
        try:
            done = spark.read.parquet(output).select(key)
            out = out.join(done.distinct(), key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        out.write.mode("append").parquet(output)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_rates(stream: DataFrame, time: str, window: str = "1 day", late: str = "30 days", **score) -> DataFrame:
    """Correct and unsupported rates per event-time window and subtype; rows later than ``late`` are dropped."""
    items = score_items(stream, keep=(time,), **score)
    return (
        items.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), "subtype")
        .agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("exact_match"), F.avg(F.col("hallucinated_figure").cast("double")).alias("unsupported_rate"))
        .select(F.col("w.start").alias("start"), "subtype", "n", "exact_match", "unsupported_rate")
    )
