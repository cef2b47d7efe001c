"""Queries over the event table (the streaming extension, run in batch)."""

from __future__ import annotations

from lineagelake.plans.registry import query
from lineagelake.streaming.incidence_stream import daily_onsets, person_time


@query("events_daily", "SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_daily(spark, sf_dir):
    return daily_onsets(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("events_person_time", "WITH p AS (SELECT user_id, min(CAST(ts AS TIMESTAMP)) AS e, max(CAST(ts AS TIMESTAMP)) AS l, min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS TIMESTAMP) END) AS o FROM events GROUP BY user_id) SELECT user_id, o IS NOT NULL AS affected, round((epoch_us(coalesce(o, l)) - epoch_us(e)) / 86400000000.0, 6) AS days FROM p")
def events_person_time(spark, sf_dir):
    return person_time(spark.read.parquet(f"{sf_dir}/events.parquet"))
