"""Streaming forms of deduplication and decontamination, and windowed counts: extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.functions.text import fold_key
from sparklex.operators.pool import exclude


def dedup_stream(stream: DataFrame, text: str, time: str, late: str = "7 days") -> DataFrame:
    """First-seen rows by text apart from white space and case, within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).withColumn("_key", fold_key(text)).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def decontaminate_stream(stream: DataFrame, block: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose columns is on the static blocklist (text)."""
    for c in columns:
        stream = exclude(stream, c, block)
    return stream


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, rows) of each window that the watermark has passed."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    return rows.select(F.col("window.start").alias("start"), "key", "rows")
