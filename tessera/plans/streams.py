"""Batch twins of the streaming operators over ``events`` (tests hold the streams against them)."""

from __future__ import annotations

from tessera.plans.registry import query
from tessera.sources.tables import events, load
from tessera.streaming import ingest
from tessera.streaming import operators as st


@query("""SELECT b AS begins, b + INTERVAL 1 HOUR AS ends, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT event_type, value, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS b FROM events) GROUP BY ALL""")
def sliding_windows(spark, d):
    """One hour every quarter of an hour."""
    from pyspark.sql import functions as F

    return st.windowed(events(spark, d), "ts", "1 hour", "event_type", slide="15 minutes").withColumn("total", F.round("total", 4))


@query()
def rate_limit(spark, d):
    """At most two accepted calls of a user in ten hours; tests compare it with a loop."""
    return st.rate_limited(events(spark, d), "user_id", "ts", "event_id", 2, 36_000.0)


@query("""SELECT user_id, count(*) AS n_events, max(ts) AS at, round(100 * (arg_max(value, ts) / 100), 2) AS percent, arg_max(value, ts) >= 100 AS complete FROM events GROUP BY user_id""")
def progress_latest(spark, d):
    """The latest progress of each document of a progress stream."""
    from pyspark.sql import functions as F

    return ingest.progress(events(spark, d).withColumn("total", F.lit(100.0)), "user_id", "ts", "value", "total")


@query("""SELECT doc_id, count(*) AS n_chunks, max(length(c))::BIGINT AS longest FROM (SELECT doc_id, unnest(list_transform(range(0, (length(text) + 999) // 1000), lambda k: substr(text, (k * 1000 + 1)::INT, 1000))) AS c FROM documents) GROUP BY doc_id""")
def stream_chunks(spark, d):
    """The chunks that the ingesting stream makes, as its batch twin."""
    from pyspark.sql import functions as F

    rows = ingest.chunked(load(spark, d, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS gap, event_id FROM events), s AS (SELECT user_id, ts, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS begins, count(*) AS n FROM s GROUP BY user_id, k""")
def session_context(spark, d):
    """A session's context lives until nothing is added for six hours."""
    from pyspark.sql import functions as F

    rows = st.sessions(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours 1 microsecond")
    return rows.select("user_id", F.col("begins").cast("timestamp_ntz").alias("begins"), "n")


@query("""WITH o AS (SELECT *, coalesce((ts - lag(ts) OVER w > INTERVAL 6 HOUR)::INT, 1) AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
c AS (SELECT *, (lag(event_type) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) IS DISTINCT FROM event_type)::BIGINT AS change FROM r)
SELECT user_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n, arg_max(event_type, (ts, event_id)) AS status, count(DISTINCT floor(value / 50)) AS n_phases, sum(change)::BIGINT AS n_changes FROM c GROUP BY user_id, run""")
def job_lifetimes(spark, d):
    """Lifetimes of job states that expire when nothing is heard for six hours: the twin of the stream with timers."""
    from pyspark.sql import functions as F

    from tessera.streaming import state

    phase = F.floor(F.col("value") / 50).cast("string").alias("phase")
    rows = events(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"), phase)
    return state.lifetimes(rows, "user_id", 6 * 3600 * 1000)
