"""Streams with state: equal to their batch twins, after a restart, with late rows and expired entries."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.sources.tables import events
from tessera.streaming import operators as st
from tessera.streaming import state

HOURS = 3600 * 1000


@pytest.fixture()
def jobs(spark, sf, tmp_path):
    """Status rows of jobs in files by time, shuffled inside each file."""
    phase = F.floor(F.col("value") / 50).cast("string").alias("phase")
    rows = events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), phase)
    parts = rows.orderBy("ts", "seq").collect()
    third = len(parts) // 3
    for k in range(3):
        spark.createDataFrame(parts[k * third :] if k == 2 else parts[k * third : (k + 1) * third], rows.schema).orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return rows, str(tmp_path)


def add(spark, tmp, name, *files):
    """Files of the stream's folder, one after another."""
    for k in files:
        frame = spark.read.parquet(f"{tmp}/in/{k}")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp}/{name}")


def drained(spark, stream, tmp, name, clock=False):
    with state.rocksdb(spark, clock):
        query = stream.writeStream.format("parquet").option("path", f"{tmp}/{name}-out").option("checkpointLocation", f"{tmp}/{name}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{tmp}/{name}-out")


COLUMNS = ["user_id", "begins", "ends", "n", "status", "n_phases", "n_changes"]


def test_lifetimes_in_a_restarted_stream(spark, jobs):
    rows, tmp = jobs
    ttl = 6 * HOURS
    for k in range(3):  # a file, a run to its end, then the next from the checkpoint
        add(spark, tmp, "jobs", k)
        got = drained(spark, state.expired_jobs(st.read_events(spark, f"{tmp}/jobs", rows.schema), "user_id", ttl, "0 seconds"), tmp, "jobs")
    last = rows.agg(F.max("ts")).first()[0]
    want = state.lifetimes(rows, "user_id", ttl).select(COLUMNS)
    ended = want.filter(F.col("ends") + F.expr("INTERVAL 6 HOURS 1 SECOND") < F.lit(last))
    have = sorted(map(tuple, got.select(COLUMNS).collect()))
    assert len(set(have)) == len(have) and set(have) <= {tuple(r) for r in want.collect()}
    assert {tuple(r) for r in ended.collect()} <= set(have) and len(have) > 20


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "user_id long, ts timestamp, seq long, status string, phase string"
    at = lambda hour, *more: [(1, f"2024-01-0{1 + int(hour // 24)} {int(hour % 24):02}:{int(hour * 60 % 60):02}:00", int(hour), *more)]

    def put(rows):
        frame = spark.createDataFrame(rows, "user_id long, ts string, seq long, status string, phase string")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return drained(spark, state.expired_jobs(st.read_events(spark, f"{tmp_path}/in", schema), "user_id", 2 * HOURS, "1 hour"), str(tmp_path), "late")

    put(at(0, "new", "a") + at(1, "done", "b"))
    put(at(20, "again", "c"))
    got = put(at(2, "too late", "d") + at(19.5, "in time", "c") + at(47, "end", "c"))
    found = sorted((r.begins.hour, r.ends.hour, r.n, r.status, r.n_phases, r.n_changes) for r in got.collect())
    assert found == [(0, 1, 2, "done", 2, 2), (19, 20, 2, "again", 1, 1)]


def test_cache_entries_expire_by_the_clock(spark, tmp_path):
    schema = "user_id long, seq long"

    def put(name, rows, ttl):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        out = drained(spark, state.cached(st.read_events(spark, f"{tmp_path}/{name}", schema), "user_id", ttl), str(tmp_path), name, clock=True)
        return {r.seq: (r.hit, r.answer) for r in out.collect()}

    put("long", [(1, 10), (1, 11), (2, 12)], 24 * HOURS)
    assert put("long", [(1, 13), (3, 14)], 24 * HOURS) == {10: (False, 10), 11: (True, 10), 12: (False, 12), 13: (True, 10), 14: (False, 14)}
    put("short", [(1, 10)], 1)
    time.sleep(0.1)
    assert put("short", [(1, 13)], 1) == {10: (False, 10), 13: (False, 13)}


def test_sessions_as_a_stream(spark, jobs):
    rows, tmp = jobs
    for k in range(3):
        add(spark, tmp, "sessions", k)
        got = drained(spark, st.sessions(st.read_events(spark, f"{tmp}/sessions", rows.schema), "ts", "user_id", "3 hours", "0 seconds"), tmp, "sessions")
    want = {tuple(r) for r in st.sessions(rows, "ts", "user_id", "3 hours").collect()}
    have = {tuple(r) for r in got.select("user_id", "begins", "ends", "n").collect()}
    assert have <= want and len(have) > 20
    last = rows.agg(F.max("ts")).first()[0]
    assert {r for r in want if r[2] < last} <= have


def test_first_seen_as_a_stream(spark, jobs):
    rows, tmp = jobs
    for k in (0, 1, 1, 2):  # a file comes twice
        add(spark, tmp, "first", k)
    got = drained(spark, st.first_seen(st.read_events(spark, f"{tmp}/first", rows.schema, 1).select("ts", "seq"), ["seq"], "ts", "60 days"), tmp, "first")
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in rows.collect())


def test_batches_that_come_again_replace_themselves(spark, jobs):
    rows, tmp = jobs
    add(spark, tmp, "kept", 0, 1)
    read = lambda: st.read_events(spark, f"{tmp}/kept", rows.schema)
    seen = lambda batch: batch.select("user_id", "ts", "seq", "status")
    state.keep_batches(read(), f"{tmp}/out", f"{tmp}/c", seen).awaitTermination()
    state.keep_batches(read(), f"{tmp}/out", f"{tmp}/other-checkpoint", seen).awaitTermination()  # the same batches again
    add(spark, tmp, "kept", 2)
    state.keep_batches(read(), f"{tmp}/out", f"{tmp}/c", seen).awaitTermination()
    assert spark.read.parquet(f"{tmp}/out").count() == rows.count()
    got = state.latest_events(spark, f"{tmp}/out", "user_id long, ts timestamp, seq long, status string", "user_id", "ts", "seq")
    want = rows.groupBy("user_id").agg(F.max(F.struct("ts", "seq", "status"))["status"].alias("status"))
    assert sorted((r.user_id, r.status) for r in got.collect()) == sorted(map(tuple, want.collect()))
