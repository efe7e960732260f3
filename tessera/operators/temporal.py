"""Versions with two time axes: half-open validity and transaction intervals, null for an open end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def scd2(rows: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """A stream of states as versions: number, validity from its time to the next one's."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    return rows.withColumns(
        {"version": F.row_number().over(w).cast("long"), "valid_from": F.col(ts), "valid_to": F.lead(ts).over(w)}
    )


def at(t: Column, begin: str = "valid_from", end: str = "valid_to") -> Column:
    """Open at an instant: begin <= t < end."""
    return (F.col(begin) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def overlaps(start: Column, stop: Column, begin: str = "valid_from", end: str = "valid_to") -> Column:
    """Closed overlap with [start, stop]."""
    return (F.col(begin) <= stop) & (F.col(end).isNull() | (F.col(end) >= start))


def as_of(t: Column) -> Column:
    """Valid and known at an instant."""
    return at(t) & at(t, "transaction_from", "transaction_to")


def between(start: Column, stop: Column) -> Column:
    """Overlapping a range on both axes."""
    return overlaps(start, stop) & overlaps(start, stop, "transaction_from", "transaction_to")


def current() -> Column:
    return F.col("valid_to").isNull() & F.col("transaction_to").isNull()


def latest(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def changed_fields(versions: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """Each version with the fields that differ from the one before (all for the first) and its kind of change."""
    w = Window.partitionBy(key).orderBy(version)
    first = F.row_number().over(w) == 1
    differ = [F.when(first | ~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields]
    return versions.withColumns(
        {"changed": F.array_join(F.array_compact(F.array(*differ)), ","), "kind": F.when(first, "create").otherwise("update")}
    )


def retain(versions: DataFrame, key: str, keep: int, now: Column, version: str = "version") -> DataFrame:
    """Close open versions beyond the last ``keep`` of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    old = F.row_number().over(w) > keep
    return versions.withColumn("transaction_to", F.when(old & F.col("transaction_to").isNull(), now).otherwise(F.col("transaction_to")))


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time.

    Both sides go into one ordered window, so the join costs one shuffle and no pairs;
    of right rows at one time the largest value counts.
    """
    tagged = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    other = right.groupBy(key, ts).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    both = tagged.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return filled.filter("_side = 1").drop("_v", "_side")
