"""Streams give what the batch twins give."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.tables import events
from tessera.streaming import operators as st


@pytest.fixture()
def parts(spark, sf, tmp_path):
    rows = events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return rows, str(tmp_path)


def same(a, b, columns):
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_windows(spark, parts):
    rows, tmp = parts
    stream = st.read_events(spark, f"{tmp}/in", rows.schema, 3)
    got = st.run_available(st.windowed(stream, "ts", "1 hour", "event_type"), "w_stream", f"{tmp}/c1", "complete")
    want = st.windowed(rows, "ts", "1 hour", "event_type")
    same(got.withColumn("total", F.round("total", 4)), want.withColumn("total", F.round("total", 4)), ["begins", "event_type", "n", "total"])


def test_rate_limit(spark, parts):
    rows, tmp = parts
    stream = st.read_events(spark, f"{tmp}/in", rows.schema, 3)
    got = st.run_available(st.rate_limited(stream, "user_id", "ts", "event_id", 2, 36_000.0), "r_stream", f"{tmp}/c2")
    same(got, st.rate_limited(rows, "user_id", "ts", "event_id", 2, 36_000.0), ["user_id", "event_id", "accepted"])


def test_latest_state(spark, parts):
    rows, tmp = parts
    fields = rows.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.col("event_type").alias("status"))
    stream = st.read_events(spark, f"{tmp}/in", rows.schema, 3).select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.col("event_type").alias("status"))
    got = st.run_available(st.latest_state(stream, "user_id", "event_id", ["amount", "status"]), "l_stream", f"{tmp}/c3", "update")
    from tessera.operators.analytics import latest_fields

    same(got, latest_fields(fields, ["user_id"], "event_id", ["amount", "status"]), ["user_id", "amount", "status"])


def test_first_seen(spark, parts):
    rows, tmp = parts
    assert st.first_seen(rows, ["user_id"], "ts").count() == rows.select("user_id").distinct().count()
