"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.registry.base import Named
from fathomgrid.streaming import ingest

N = Named()


@N.query("stream_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, root):
    out = ingest.drain(ingest.event_windows(ingest.read(spark, root, "events")), spark)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@N.query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, k""")
def stream_sessions(spark, root):
    out = ingest.drain(ingest.sessions(ingest.read(spark, root, "events"), late="10 minutes"), spark)
    return out.select("user_id", F.col("n").cast("long").alias("n"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")])


QUERIES, SQL = N.QUERIES, N.SQL
