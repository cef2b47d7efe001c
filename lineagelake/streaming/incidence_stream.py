"""An extension for event streams: purchases as onsets, counted by day with a watermark. The batch engine needs no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_onsets(events: DataFrame, late: str = "1 day") -> DataFrame:
    """events (ts, user_id, event_type, value), streaming or not -> (day as text, event_type, n, total)."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    out = ts.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def person_time(events: DataFrame, onset: str = "purchase") -> DataFrame:
    """Per user: first event, first onset, and days under observation until onset or the last event."""
    ts = F.col("ts").cast("timestamp")
    out = events.groupBy("user_id").agg(F.min(ts).alias("entry"), F.max(ts).alias("last"), F.min(F.when(F.col("event_type") == onset, ts)).alias("onset"))
    end = F.coalesce("onset", "last")
    return out.select("user_id", F.col("onset").isNotNull().alias("affected"), F.round((F.unix_micros(end) - F.unix_micros("entry")) / 86_400e6, 6).alias("days"))
