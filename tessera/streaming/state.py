"""Keyed state with timers and time to live, and sinks that survive a repeated batch.

A job's status lives until nothing is heard of it for a while (event time, by a timer): a
``lifetime``. Its state is a value (when, how often, last status), a map (phases) and a
list (status changes). ``lifetimes`` is the batch twin. A cache entry lives by the clock
(``ttlDurationMs`` of its value state). Both keep their state in RocksDB.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.operators import LATE

_LIFETIME = "begins timestamp, ends timestamp, n long, status string, n_phases long, n_changes long"


class JobStatus(StatefulProcessor):
    """Folds rows (ts, status, phase) of a key to its lifetime, and puts it out when it has expired."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "begins long, ends long, n long, status string")
        self.phases = handle.getMapState("phases", "phase string", "n long")
        self.changes = handle.getListState("changes", "at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        micros = frame["ts"].astype("datetime64[us]").astype("int64")
        own = self.current.get() if self.current.exists() else None
        for at, status, phase in zip(micros.tolist(), frame["status"], frame["phase"]):
            if own and at > own[1] + self.ttl * 1000:
                yield self._closed(key, own)
                own = None
            late = own is not None and at < own[1]  # behind a row of an earlier batch
            if own is None or (own[3] != status and not late):
                self.changes.appendValue((at, status))
            before = self.phases.getValue((phase,))[0] if self.phases.containsKey((phase,)) else 0
            self.phases.updateValue((phase,), (before + 1,))
            own = (at, at, 1, status) if own is None else (min(own[0], at), max(own[1], at), own[2] + 1, own[3] if late else status)
        self.current.update(own)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(own[1] // 1000 + 1 + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.current.exists():
            yield self._closed(key, self.current.get())

    def _closed(self, key, own) -> pd.DataFrame:
        n_phases, n_changes = len(list(self.phases.keys())), len(list(self.changes.get()))
        for state in (self.current, self.phases, self.changes):
            state.clear()
        at = [pd.Timestamp(x, unit="us") for x in own[:2]]
        return pd.DataFrame([[key[0], *at, own[2], own[3], n_phases, n_changes]], columns=[self.key, "begins", "ends", "n", "status", "n_phases", "n_changes"])

    def close(self) -> None:
        pass


def expired_jobs(rows: DataFrame, key: str, ttl_ms: int, late: str = LATE) -> DataFrame:
    """A stream of the lifetimes that have ended of rows (key, ts, seq, status, phase); rows behind the watermark are dropped."""
    kind = dict(rows.dtypes)[key]
    named = rows.select(key, "ts", "seq", "status", "phase").withWatermark("ts", late)
    return named.groupBy(key).transformWithStateInPandas(JobStatus(key, ttl_ms), f"{key} {kind}, {_LIFETIME}", "append", "eventTime")


def lifetimes(rows: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """All lifetimes of a table: runs of a key's rows with no gap of more than the time to live."""
    order = Window.partitionBy(key).orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    marked = rows.withColumn("_new", F.coalesce((gap > ttl_ms * 1000).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.lag("status").over(Window.partitionBy(key, "_run").orderBy("ts", "seq"))
    marked = marked.withColumn("_change", (change.isNull() | (change != F.col("status"))).cast("long"))
    last = F.max(F.struct("ts", "seq", "status"))["status"].alias("status")
    sums = [F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("n"), last, F.count_distinct("phase").alias("n_phases"), F.sum("_change").alias("n_changes")]
    return marked.groupBy(key, "_run").agg(*sums).drop("_run")


class Cache(StatefulProcessor):
    """Marks each row of a key as a hit or a miss of an entry that lives ``ttl_ms`` by the clock after it was written."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "id long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        ids = frame["seq"].tolist()
        found = self.entry.get()[0] if self.entry.exists() else None
        if found is None:
            self.entry.update((ids[0],))
        hits = [found is not None] + [True] * (len(ids) - 1)
        yield pd.DataFrame({self.key: [key[0]] * len(ids), "seq": ids, "hit": hits, "answer": [ids[0] if found is None else found] * len(ids)})

    def close(self) -> None:
        pass


def cached(rows: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """A stream of (key, seq, hit, answer): the first row of a key fills the cache, later ones are answered by it until it expires."""
    kind = dict(rows.dtypes)[key]
    return rows.select(key, "seq").groupBy(key).transformWithStateInPandas(Cache(key, ttl_ms), f"{key} {kind}, seq long, hit boolean, answer long", "append", "processingTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession, clock: bool = False):
    """The state store of ``transformWithState``, for the streams that start inside.

    ``clock``: batches without data are off, as a drain of a stream by the clock would ask for one more forever.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if clock:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def keep_batches(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Start a drain of an event stream to Parquet, a folder for each batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_events(spark: SparkSession, folder: str, schema, key: str, *order: str) -> DataFrame:
    """Each key's last event of the kept batches."""
    rows = spark.read.schema(schema).parquet(folder)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", newest).filter("_r = 1").drop("_r")
