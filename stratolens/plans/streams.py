"""Event streams, run to their end over the events table."""

from __future__ import annotations

from ..streaming import jobs, latency
from .base import Tables, query
from .intervals import SQL_LAST

WINDOWS = "SELECT time_bucket(INTERVAL '{0}', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(WINDOWS.format("1 hour"))
def stream_tumbling(t: Tables):
    return jobs.windowed_counts(t.spark, t.sf_dir, "1 hour")


@query("""SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY ALL""")
def stream_sliding(t: Tables):
    return jobs.windowed_counts(t.spark, t.sf_dir, "2 hours", "1 hour")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, island""")
def stream_sessions(t: Tables):
    return jobs.sessions(t.spark, t.sf_dir, "30 minutes")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables):
    return jobs.distinct_keys(t.spark, t.sf_dir)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {SQL_LAST})
SELECT event_type, max(n) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(max(CASE WHEN r = CAST(ceil(0.95 * n) AS BIGINT) THEN value END), 6) AS p95, round(max(CASE WHEN back = 1 THEN value END), 6) AS last FROM r GROUP BY event_type""")
def stream_latency_last250(t: Tables):
    """The last 250 samples of each type as list state; the rows of latency_p95_last250."""
    return latency.event_latencies(t.spark, t.sf_dir).withColumnRenamed("key", "event_type")
