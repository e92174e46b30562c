"""Streams: upserting arrivals into a table, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import store


def upsert_stream(arrivals: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]):
    """A stream writer that upserts each micro-batch; a repeated batch gives the same table."""

    def batch(df: DataFrame, _: int) -> None:
        store.upsert(df, path, keys, [F.col(c) for c in order])

    return arrivals.writeStream.foreachBatch(batch)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start``, ``event_type``, ``n``, ``total``: tumbling windows; arrivals later than ``late`` are dropped by the stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id``, ``start``, ``n``: runs of a user's events with less than ``gap`` between them."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
