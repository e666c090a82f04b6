"""Streaming twins of batch queries, run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.plans.catalog import query
from mnemora.shared import scratch
from mnemora.streaming import late, sessions, twins


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    return twins.finished(spark, sf_dir, "events", twins.daily_counts).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id AS key, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id HAVING count(*) >= 2")
def stream_pending_counts(spark, sf_dir):
    return twins.finished(spark, sf_dir, "events", twins.pending_counts).filter("n >= 2")


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS new FROM events),
s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    out = twins.finished(spark, sf_dir, "events", sessions.gap_sessions)
    return out.select("user_id", "events", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("""SELECT user_id::VARCHAR AS key, count(DISTINCT event_id) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_reinforced,
  max(ts) + INTERVAL 3 DAY < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS dormant FROM events GROUP BY user_id""")
def stream_late_events(spark, sf_dir):
    """Every user's sightings out of a change log that each file of the stream corrects; users silent for three days at the watermark are dormant."""
    events = twins.file_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    path = scratch(spark, "late-log")
    late.keep(late.change_log(events, "7 days", "3 days"), path, scratch(spark, "late-state"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return late.holding(spark, path).select("key", "n", at("first_seen"), at("last_reinforced"), "dormant")
