"""Structured Streaming counterparts; the same functions take batch tables, so stream and batch agree.

The watermark is this library's choice: rows later than ``LATE`` are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, bounded by files a trigger (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    return rows.withWatermark(ts, late) if rows.isStreaming else rows


def windowed(rows: DataFrame, ts: str, size: str, *keys: str, slide: str | None = None, value: str = "value", late: str = LATE) -> DataFrame:
    """Counts and sums by tumbling, or with ``slide`` sliding windows and keys."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _timed(rows, ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *keys, "n", "total")


def sessions(rows: DataFrame, ts: str, key: str, gap: str, late: str = LATE) -> DataFrame:
    """Sessions of each key, ``gap`` apart at least."""
    out = _timed(rows, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def first_seen(rows: DataFrame, keys: list[str], ts: str, late: str = LATE) -> DataFrame:
    """Repeated keys go; a stream forgets keys behind the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def latest_state(rows: DataFrame, key: str, seq: str, fields: list[str], ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Partial updates folded by key: each trigger gives the touched keys' last non-null fields.

    A key untouched for ``ttl_ms`` is forgotten. State is one row a key.
    """
    kinds = dict(rows.dtypes)
    out_schema = f"{key} {kinds[key]}, " + ", ".join(f"{f} {kinds[f]}" for f in fields)
    state_schema = ", ".join(f"{f} {kinds[f]}, {f}_seq long" for f in fields)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = list(state.get) if state.exists else [None, -1] * len(fields)
        for frame in frames:
            for n, f in enumerate(fields):
                some = frame[frame[f].notna()]
                if len(some):
                    last = some.loc[some[seq].idxmax()]
                    if int(last[seq]) > own[2 * n + 1]:
                        own[2 * n], own[2 * n + 1] = last[f], int(last[seq])
        state.update(tuple(own))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([[k[0], *own[0::2]]], columns=[key, *fields])

    return rows.groupBy(key).applyInPandasWithState(fold, out_schema, state_schema, "update", GroupStateTimeout.ProcessingTimeTimeout)


def accepted_calls(times: list[float], limit: int, span: float = 60.0, recent: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which calls (seconds, ascending) pass a trailing limit; refused ones don't count."""
    kept, out = list(recent or []), []
    for t in times:
        kept = [x for x in kept if x > t - span]
        fine = len(kept) < limit
        if fine:
            kept.append(t)
        out.append(fine)
    return out, kept


def rate_limited(rows: DataFrame, key: str, ts: str, id_: str, limit: int, span: float = 60.0) -> DataFrame:
    """(key, id, accepted) of every call under a trailing limit by key: a fold over each key's order.

    On a stream a key's recent accepted calls are its state, at most ``limit`` times.
    """
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, {id_} {kinds[id_]}, accepted boolean"

    def decide(frame: pd.DataFrame, recent: list[float]):
        frame = frame.sort_values([ts, id_])
        seconds = (frame[ts].astype("int64") / 1e6 if "us" in str(frame[ts].dtype) else frame[ts].astype("int64") / 1e9).tolist()
        fine, recent = accepted_calls(seconds, limit, span, recent)
        return frame[[key, id_]].assign(accepted=fine), recent

    if not rows.isStreaming:
        return rows.groupBy(key).applyInPandas(lambda frame: decide(frame, [])[0], schema)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        out, recent = decide(pd.concat(list(frames)), recent)
        state.update((recent,))
        yield out

    return rows.groupBy(key).applyInPandasWithState(fold, schema, "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into an in-memory table: for tests and small jobs.

    Batches without data are off: a processing-time timeout would ask for one more of them forever.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        done = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        conf.set(key, before)
    return stream.sparkSession.table(name)
