"""Ledger, telemetry and progress aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import saved, small


def ledger(rows: DataFrame, provider: str, model: str, cost: str, tokens: str) -> DataFrame:
    """Totals over all, by provider, and by provider and model, in one pass."""
    named = rows.select(F.col(provider).alias("provider"), F.col(model).alias("model"), F.col(cost).alias("cost"), F.col(tokens).alias("tokens"))
    out = named.groupingSets([[], ["provider"], ["provider", "model"]], "provider", "model").agg(
        F.grouping_id().cast("long").alias("level"),
        F.count("*").alias("n"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
    )
    return out.select("provider", "model", "level", "n", "cost", "tokens")


def monday_week(ts: Column) -> Column:
    """``%Y-W%W``: weeks begin on Monday, days before the first one are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def period(ts: Column, unit: str) -> Column:
    return {"daily": F.date_format(ts, "yyyy-MM-dd"), "weekly": monday_week(ts), "monthly": F.date_format(ts, "yyyy-MM")}[unit]


def indexed_quantile(value: Column, q: float) -> Column:
    """sorted[min(int(n * q), n - 1)] as an aggregate over non-null values."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, F.least(F.floor(F.size(values) * q), F.size(values) - 1).cast("int") + 1)


def indexed_quantiles(rows: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """The same by ranks, without gathering a group's values in one row or task."""
    ranked = ranks(rows.filter(F.col(value).isNotNull()).select(*group, value), group, value)
    at = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1) + 1
    return ranked.filter(F.col("_r") == at).select(*group, F.col(value).alias(name))


def running(rows: DataFrame, group: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows with the running sum ``name`` of ``value`` in their group's total order; null is a group.

    The rows are range-partitioned by group and order, so a large group spans many tasks; each
    partition sums its own rows and adds what the partitions before it hold.
    """
    key = ["_z", "_g"]
    keyed = rows.withColumns({"_z": F.col(group).isNull(), "_g": F.coalesce(F.col(group).cast("string"), F.lit("")), name: value})
    placed = keyed.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = saved(placed.withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_p", *key).agg(F.sum(name).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    own = Window.partitionBy("_p", *key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_run", F.sum(name).over(own)).join(small(sums.drop("_s")), ["_p", *key])
    return out.withColumn(name, F.col("_run") + F.col("_before")).drop("_p", "_at", "_run", "_before", *key)


def ranks(rows: DataFrame, group: list[str], *order: str) -> DataFrame:
    """Rows with their rank ``_r`` in their group's order (groups are not null) and the group's size ``_n``.

    The rows are range-partitioned by group and order, so a large group spans many tasks;
    a partition's rows get their places from counts of the partitions before it.
    """
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = saved(placed.withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_p", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    out = placed.join(small(counts), ["_p", *group])
    return out.withColumn("_r", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_p", "_at", "_first", "_c", "_before")


def exclusive_quantiles(rows: DataFrame, group: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """(group, q, value): exclusive quantiles by ranks, see ``exclusive_quantile``."""
    ranked = ranks(rows.filter(F.col(value).isNotNull()).select(*group, value), group, value)
    place = lambda q: F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), q * (F.col("_n") + 1)))
    low = lambda q: F.floor(place(q))
    ends = [F.max(F.when(F.col("_r") == F.least(low(q) + k, F.col("_n")), F.col(value))).alias(f"_{i}_{k}") for i, q in enumerate(qs) for k in (0, 1)]
    found = ranked.groupBy(*group).agg(F.first("_n").alias("_n"), *ends)
    at = lambda i, q: F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * (place(q) - low(q))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), at(i, q).alias("value")) for i, q in enumerate(qs)]))
    return found.select(*group, each.alias("x")).select(*group, "x.q", "x.value")


def exclusive_quantile(values: Column, q: float) -> Column:
    """Exclusive quantile of a sorted array: place q (n + 1), interpolated, clamped to the ends."""
    n = F.size(values)
    place = F.greatest(F.lit(1.0), F.least(n.cast("double"), q * (n + 1)))
    low = F.floor(place).cast("int")
    high = F.least(low + 1, n)
    a, b = F.element_at(values, low), F.element_at(values, high)
    return a + (b - a) * (place - low)


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], *group: str) -> DataFrame:
    """Cumulative counts ``le`` for each bound and infinity."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*group).agg(*counts, F.count(value).alias("le_inf"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def latest_fields(rows: DataFrame, keys: list[str], seq: str, fields: list[str]) -> DataFrame:
    """Partial updates folded: for each key the last non-null value of every field."""
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return rows.groupBy(*keys).agg(*last)


def cache_stats(keys: DataFrame, group: str, requests: str) -> DataFrame:
    """Hits, misses and hit rate (percent) of a cache from the requests of each key: the first one misses."""
    hits, misses = F.sum(F.col(requests) - 1), F.count("*")
    return keys.groupBy(group).agg(hits.alias("hits"), misses.alias("misses"), F.round(hits / (hits + misses) * 100, 2).alias("hit_rate"))


def stored_entries(log: DataFrame, key: list[str], ts: str, now: Column, ttl: int) -> DataFrame:
    """Entries of a key-value log: last written, accesses, and seconds left to live (negative: expired)."""
    rows = log.groupBy(*key).agg(F.max(ts).alias("stored"), F.count("*").alias("accesses"))
    age = F.floor((F.unix_micros(now) / 1_000_000)) - F.floor(F.unix_micros(F.col("stored").cast("timestamp")) / 1_000_000)
    return rows.withColumn("ttl", F.lit(ttl) - age)


def rebalance(budgets: DataFrame, manager: str, skill: str, total: int) -> DataFrame:
    """(manager, skill, allocated) after one pass in order: used below 30 % shrinks to 70 %, above 90 % grows by what is free.

    ``budgets``: manager, skill, allocated, used. Growth takes the lesser of half the free
    tokens and the budget itself, so the order counts; a manager's skills are one small group.
    """
    kinds = dict(budgets.dtypes)

    def fold(frame):
        frame = frame.sort_values(skill).reset_index(drop=True)
        allocated = frame["allocated"].astype("int64").tolist()
        for k, used in enumerate(frame["used"]):
            share = used / allocated[k] if allocated[k] else 0.0
            if share < 0.3:
                allocated[k] = int(allocated[k] * 0.7)
            elif share > 0.9:
                allocated[k] += max(0, min((total - sum(allocated)) // 2, allocated[k]))
        return frame.assign(allocated=allocated)[[manager, skill, "allocated"]]

    return budgets.groupBy(manager).applyInPandas(fold, f"{manager} {kinds[manager]}, {skill} {kinds[skill]}, allocated long")
