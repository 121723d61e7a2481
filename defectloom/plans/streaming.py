"""Streaming plans over events; each is drained once and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectloom.plans.registry import query
from defectloom.session import work_folder
from defectloom.streaming import incremental as S
from defectloom.streaming import state as T


def _events(spark, d):
    return S.commit_stream(spark, f"{d}/events.parquet").select("event_id", "user_id", "ts", "event_type")


@query("SELECT DISTINCT event_id, user_id, ts, event_type FROM events")
def incremental_mining(spark, d):
    return S.drain(S.new_commits(_events(spark, d)), work_folder(spark)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def ttl_dedup(spark, d):
    return S.drain(S.recent_commits(_events(spark, d)), work_folder(spark)).select("event_id", "user_id")


@query("""SELECT user_id, w AS window_start, count(*) AS commits FROM (SELECT user_id, unnest(generate_series(date_trunc('day', ts)::TIMESTAMP - INTERVAL 13 DAY, date_trunc('day', ts)::TIMESTAMP, INTERVAL 1 DAY)) AS w FROM events) GROUP BY 1, 2""")
def streaming_windows(spark, d):
    out = S.drain(S.sliding_counts(_events(spark, d), "user_id"), work_folder(spark), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, max(ts)::TIMESTAMP + INTERVAL 6 HOUR AS session_end, count(*) AS commits FROM s GROUP BY user_id, n""")
def burst_sessions(spark, d):
    out = S.drain(S.bursts(_events(spark, d), "user_id"), work_folder(spark), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT 0::BIGINT AS batch, count(*) AS rows FROM events")
def stream_progress(spark, d):
    """What a stream over all events told while it ran: one batch, as there is one file."""
    return S.drain_told(_events(spark, d), work_folder(spark))


@query("SELECT user_id::VARCHAR AS key, 'made' AS event, count(*) AS rows FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def ttl_entries(spark, d):
    """The entries that a stream over all events makes, one for each user; they end after an hour by the clock, which no run of this query takes."""
    with T.rocksdb_state(spark):
        return S.drain(T.entries(_events(spark, d), "user_id", T.RESULT_MINUTES), work_folder(spark), "update").select("key", "event", "rows")
