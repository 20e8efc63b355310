"""Structured Streaming forms of late uploads and redelivered messages (rows 386, 387)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(stream: DataFrame, key: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Messages without those delivered again within the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts in event-time windows; with a batch DataFrame the same rows at once."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key: what an upsert leaves."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(stream: DataFrame, key: list[str], order: list[str], checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch's latest versions to write(rows, batch id), which must be idempotent by that id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(latest(df, key, order), n)).start()
