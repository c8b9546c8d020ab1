"""Queries of the streaming operators over the table of events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.runtime import table
from ctxspark.streaming.refresh import counted_windows, session_counts


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with gaps under six hours."""
    found = session_counts(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return found.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_events")


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, read as a stream."""
    found = counted_windows(spark, f"{d}/events.parquet", "ts", "event_type", "1 day")
    return found.select("event_type", F.date_format("started", "yyyy-MM-dd").alias("day"), "n_rows")


QUERIES = {"event_sessions": event_sessions, "stream_event_windows": stream_event_windows}

ORACLE = {
    "event_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_events FROM n GROUP BY user_id, n""",
    "stream_event_windows": "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_rows FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
