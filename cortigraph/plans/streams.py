"""Streaming queries over events, and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.session import table
from cortigraph.streaming import events


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sliding windows (those the watermark has passed)."""
    out = events.drained(events.sliding_stats(events.source(spark, sf_dir), "6 hours", "3 hours", "1 hour"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_events"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drained(events.episodes(events.source(spark, sf_dir), "30 minutes", "1 hour")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))


def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.drained(events.running_baseline(events.source(spark, sf_dir)), "update")
    return out.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("mean", "batch"), 6).alias("mean"), F.round(F.max_by("std", "batch"), 6).alias("std"))


def session_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of the whole table, in one batch."""
    e = table(spark, sf_dir, "events").where("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return w.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("high", 6).alias("high"))


FOUND = {f.__name__: f for f in (stream_windows, stream_sessions, stream_baseline, session_episodes, window_stats)}
SQL = {
    # Windows and sessions that end before the watermark, an hour behind the latest event.
    "stream_windows": """WITH w AS (SELECT event_type, unnest([floor(epoch_us(ts) / 10800000000) * 10800000000, floor(epoch_us(ts) / 10800000000) * 10800000000 - 10800000000]) AS s FROM events WHERE ts IS NOT NULL),
k AS (SELECT event_type, s, count(*) AS n FROM w WHERE s + 21600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events) GROUP BY 1, 2)
SELECT event_type, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n_events FROM k GROUP BY 1""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
n AS (SELECT user_id, k, count(*) AS n, max(epoch_us(ts)) + 1800000000 AS e FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events FROM n WHERE e <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events) GROUP BY user_id""",
    "stream_baseline": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type",
    "session_episodes": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS longest FROM n GROUP BY user_id""",
    "window_stats": "SELECT CAST(floor(epoch_us(ts) / 21600000000) * 21600000000 AS BIGINT) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
