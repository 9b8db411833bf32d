"""Streaming counterpart of gap clustering for point events, and incremental decisions over a stream of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def session_clusters(events: DataFrame, time: str, by: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of point events of a key that are nearer than ``gap``; later than ``lateness`` behind the watermark they are dropped.

    It equals gap clustering where all items are points; intervals need the batch operator with its running maximum.
    """
    rows = events.withWatermark(time, lateness)
    found = rows.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("members"))
    return found.select(by, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("closed"), "members")


def windowed_counts(events: DataFrame, time: str, by: str, width: str, lateness: str) -> DataFrame:
    rows = events.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), by, "n")
