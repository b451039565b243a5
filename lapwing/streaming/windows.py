"""Duplicate rates of arrivals over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = ("n_events", "n_duplicates", "duplicate_rate")


def decided(arrivals: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Arrivals (item_id, ...) with ``is_duplicate``: whether ``duplicates`` (item_id), a table, holds their item."""
    known = duplicates.select(F.col("item_id").alias("_item")).distinct()
    return arrivals.join(known, F.col("item_id") == F.col("_item"), "left").withColumn("is_duplicate", F.col("_item").isNotNull()).drop("_item")


def _rates(arrivals: DataFrame, window: Column, late: str, key: str) -> DataFrame:
    """Counts by ``key`` and window, once the watermark, ``late`` behind the latest event, has passed the window's end. Rows older than the watermark that
    their micro-batch began with belong to no window any more and are dropped."""
    n = F.sum(F.col("is_duplicate").cast("long"))
    out = arrivals.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n_events"), n.alias("n_duplicates"))
    return out.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), *RATES[:2], (F.col("n_duplicates") / F.col("n_events")).alias(RATES[2]))


def window_rates(arrivals: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(key, from_ts, to_ts, n_events, n_duplicates, duplicate_rate) of arrivals (ts, key, is_duplicate) in windows of ``size``, every ``slide`` (of ``size`` where
    it is not given)."""
    return _rates(arrivals, F.window("ts", size, slide or size), late, key)


def session_rates(arrivals: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """The same for sessions: stretches of a key's arrivals that are less than ``gap`` apart; a session ends ``gap`` after its last arrival."""
    return _rates(arrivals, F.session_window("ts", gap), late, key)
