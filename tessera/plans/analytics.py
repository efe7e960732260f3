"""Ledger and telemetry queries: event_type is the provider or stage, value the cost or latency, k the tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import analytics as an
from tessera.plans.registry import query
from tessera.sources.tables import events, load

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(f"""SELECT provider, model, CASE WHEN g = 3 THEN 3 WHEN g = 1 THEN 1 ELSE 0 END::BIGINT AS level, n, cost, tokens FROM (
SELECT event_type AS provider, 'm' || (user_id % 5) AS model, grouping(event_type, 'm' || (user_id % 5)) AS g, count(*) AS n,
round(coalesce(sum(value), 0), 4) AS cost, coalesce(sum({_K}), 0)::BIGINT AS tokens FROM events
GROUP BY GROUPING SETS ((), (event_type), (event_type, 'm' || (user_id % 5))))""")
def ledger_grouping_sets(spark, d):
    """Cost report: total, by provider, by provider and model."""
    rows = events(spark, d).withColumn("model", F.concat(F.lit("m"), F.pmod("user_id", F.lit(5)).cast("string")))
    return an.ledger(rows, "event_type", "model", "value", "k")


def _series(spark, d, unit):
    rows = events(spark, d).withColumn("period", an.period(F.col("ts"), unit))
    return rows.groupBy("period", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.sum("k").cast("long").alias("tokens")
    )


_SERIES = "SELECT strftime(ts, '{0}') AS period, event_type, count(*) AS n, round(sum(value), 4) AS cost, sum(" + _K + ")::BIGINT AS tokens FROM events GROUP BY ALL"


@query(_SERIES.format("%Y-%m-%d"))
def ledger_timeseries_daily(spark, d):
    return _series(spark, d, "daily")


@query(_SERIES.format("%Y-W%W"))
def ledger_timeseries_weekly(spark, d):
    """Weeks from Monday, numbered from 00."""
    return _series(spark, d, "weekly")


@query(_SERIES.format("%Y-%m"))
def ledger_timeseries_monthly(spark, d):
    return _series(spark, d, "monthly")


@query("SELECT event_type AS provider, round(sum(value), 4) AS spent, CASE WHEN sum(value) < 80000 THEN 'ok' WHEN sum(value) < 100000 THEN 'warning' ELSE 'critical' END AS status FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY event_type")
def monthly_spend(spark, d):
    """Spend of a month by provider, against a budget."""
    rows = events(spark, d).filter((F.col("ts") >= "2024-01-01") & (F.col("ts") < "2024-02-01"))
    spent = F.sum("value")
    status = F.when(spent < 80000, "ok").when(spent < 100000, "warning").otherwise("critical")
    return rows.groupBy(F.col("event_type").alias("provider")).agg(F.round(spent, 4).alias("spent"), status.alias("status"))


@query("SELECT coalesce(round(sum(value), 4), 0.0) AS total FROM events WHERE ts >= TIMESTAMP '2030-01-01'")
def empty_range_total(spark, d):
    """The total of an empty range is zero, not null."""
    return events(spark, d).filter(F.col("ts") >= "2030-01-01").agg(F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("total"))


@query(f"""SELECT event_type AS provider, count(*) AS n, round(sum(value), 4) AS cost, round(avg(value), 6) AS avg_cost, round(avg({_K}), 6) AS avg_tokens,
sum(CASE WHEN {_K} >= 50 THEN 1 ELSE 0 END)::BIGINT AS fallbacks, min({_K}) AS least, max({_K}) AS most FROM events GROUP BY event_type""")
def request_stats(spark, d):
    """Counts, sums, means and conditional counts by provider."""
    return events(spark, d).groupBy(F.col("event_type").alias("provider")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.avg("value"), 6).alias("avg_cost"),
        F.round(F.avg("k"), 6).alias("avg_tokens"), F.count_if(F.col("k") >= 50).alias("fallbacks"), F.min("k").alias("least"), F.max("k").alias("most"),
    )


@query("""SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS avg_ms, list_sort(list(value))[least(floor(count(*) * 0.95), count(*) - 1)::INT + 1] AS p95_ms,
round(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY event_type""")
def trace_metrics(spark, d):
    """Mean, 95th percentile by index and hit rate of each stage."""
    rows = events(spark, d).withColumnRenamed("event_type", "stage")
    sums = rows.groupBy("stage").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_ms"), F.round(F.count_if(F.col("user_id") % 2 == 0) / F.count("*"), 6).alias("hit_rate")
    )
    return sums.join(an.indexed_quantiles(rows, ["stage"], "value", 0.95, "p95_ms"), "stage").select("stage", "n", "avg_ms", "p95_ms", "hit_rate")


@query("""WITH v AS (SELECT user_id, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY user_id), p AS (SELECT user_id, s, n, unnest([0.5, 0.95, 0.99])::DOUBLE AS q FROM v),
x AS (SELECT user_id, q, s, n, greatest(1.0, least(n, q * (n + 1)))::DOUBLE AS pos FROM p)
SELECT user_id, q, round(s[floor(pos)::INT] + (s[least(floor(pos)::INT + 1, n)] - s[floor(pos)::INT]) * (pos - floor(pos)), 6) AS value FROM x""")
def percentiles_exclusive(spark, d):
    """Exclusive p50, p95 and p99 of each user's values."""
    found = an.exclusive_quantiles(events(spark, d), ["user_id"], "value", (0.5, 0.95, 0.99))
    return found.withColumn("value", F.round("value", 6))


@query("""SELECT event_type AS stage, count(*) FILTER (value <= 1.0) AS le_1_0, count(*) FILTER (value <= 5.0) AS le_5_0, count(*) FILTER (value <= 10.0) AS le_10_0, count(*) FILTER (value <= 50.0) AS le_50_0, count(value) AS le_inf FROM events GROUP BY event_type""")
def latency_histogram(spark, d):
    """Cumulative latency buckets of each stage."""
    return an.histogram(events(spark, d).withColumnRenamed("event_type", "stage"), "value", (1.0, 5.0, 10.0, 50.0), "stage")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def stage_pivot(spark, d):
    """Day by kind of event."""
    rows = events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.groupBy("day").pivot("event_type", ["click", "view", "error"]).agg(F.count("event_id")).fillna(0)


@query("""SELECT event_type AS model, metric, round(sum(v), 4) AS total, count(*) AS n FROM (SELECT event_type, 'value' AS metric, value AS v FROM events UNION ALL SELECT event_type, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events) GROUP BY ALL""")
def pipeline_stage_summary(spark, d):
    """Numeric metrics of each stage, unpivoted."""
    rows = events(spark, d).select(F.col("event_type").alias("model"), F.explode(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k").cast("double"))).alias("metric", "v"))
    return rows.groupBy("model", "metric").agg(F.round(F.sum("v"), 4).alias("total"), F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, count(DISTINCT event_type) AS kinds, round(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS share FROM events GROUP BY user_id""")
def skill_usage(spark, d):
    """Usage of each skill and its share of all."""
    rows = events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.round(F.avg("value"), 4).alias("mean"), F.count_distinct("event_type").alias("kinds"),
    )
    total = events(spark, d).agg(F.count("*").alias("all"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("n") / F.col("all"), 1)).drop("all")


@query("""SELECT source, count(*) AS n_chunks, sum(length(text) // 4)::BIGINT AS tokens, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source""")
def document_rollup(spark, d):
    """Documents from their chunks: tokens and counts."""
    return load(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n_chunks"), F.sum(F.floor(F.length("text") / 4)).cast("long").alias("tokens"), F.count_distinct("lang").alias("n_langs")
    )


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))""")
def stratification_counts(spark, d):
    """Rows by language and by source, in one pass."""
    return load(spark, d, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n")).select("lang", "source", "n")


@query("""SELECT user_id, count(*) AS n_changes, min(ts) AS first_ts, max(ts) AS last_ts, round(count(*) / greatest(date_diff('day', min(ts)::DATE, max(ts)::DATE), 1)::DOUBLE, 6) AS per_day FROM events GROUP BY user_id""")
def change_stats(spark, d):
    """Changes of each entity and how many a day."""
    days = F.greatest(F.datediff(F.max("ts"), F.min("ts")), F.lit(1))
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n_changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.count("*") / days, 6).alias("per_day"))


@query("""SELECT user_id, n, round(n / 7.0::DOUBLE, 6) AS rate, CASE WHEN n / 7.0 > 2 THEN 'high' WHEN n / 7.0 > 1.5 THEN 'medium' ELSE 'low' END AS drift, kinds FROM (
SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY user_id)""")
def drift(spark, d):
    """Change rate of the last week and its grade."""
    rows = events(spark, d).filter(F.col("ts") >= "2024-01-24").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
    per_day = F.col("n") / 7
    return rows.select("user_id", "n", F.round(per_day, 6).alias("rate"), F.when(per_day > 2, "high").when(per_day > 1.5, "medium").otherwise("low").alias("drift"), "kinds")


@query("""SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey HAVING count(*) >= 3) ON o_custkey = c_custkey""")
def active_entities(spark, d):
    """Entities with at least three changes since a date."""
    counts = load(spark, d, "orders").filter(F.col("o_orderdate") >= "1998-01-01").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 3")
    return counts.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n")


@query("""SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type = 'purchase') AS amount, arg_max(ts, event_id) FILTER (event_type = 'error') AS failed_at FROM events GROUP BY user_id""")
def progress_state(spark, d):
    """Partial updates: the last non-null value of each field."""
    rows = events(spark, d).select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.when(F.col("event_type") == "error", F.col("ts")).alias("failed_at"))
    return an.latest_fields(rows, ["user_id"], "event_id", ["status", "amount", "failed_at"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS begins, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """Sessions of each user, six hours apart at least."""
    return events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), "n")


@query("""SELECT event_type, n_ok, n_bad, round(n_ok / (n_ok + n_bad)::DOUBLE, 6) AS success, CASE WHEN n_bad > 0.1 * (n_ok + n_bad) THEN 'issue' ELSE 'ok' END AS verdict FROM (
SELECT event_type, count(*) FILTER (value >= 5) AS n_ok, count(*) FILTER (value < 5) AS n_bad FROM events GROUP BY event_type)""")
def compliance_report(spark, d):
    """Failures by kind against a tenth."""
    rows = events(spark, d).groupBy("event_type").agg(F.count_if(F.col("value") >= 5).alias("n_ok"), F.count_if(F.col("value") < 5).alias("n_bad"))
    every = F.col("n_ok") + F.col("n_bad")
    return rows.select("event_type", "n_ok", "n_bad", F.round(F.col("n_ok") / every, 6).alias("success"), F.when(F.col("n_bad") > 0.1 * every, "issue").otherwise("ok").alias("verdict"))


@query("""WITH m AS (SELECT user_id % 3 AS part, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS n, round(sum(v) / sum(n), 6) AS coverage, max(n) AS rounds FROM m GROUP BY event_type""")
def mergeable_metrics(spark, d):
    """Partial metrics merged: sums add, maxima stay, coverage comes from the sums."""
    parts = events(spark, d).groupBy((F.col("user_id") % 3).alias("part"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v") / F.sum("n"), 6).alias("coverage"), F.max("n").alias("rounds"))


@query("""SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 0.25 WHEN 'view' THEN 0.15 WHEN 'click' THEN 0.2 ELSE 0.05 END * CASE WHEN n > 10 THEN 1 ELSE 0.5 END), 6)::DOUBLE AS progress FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def stage_progress(spark, d):
    """Weighted progress, half credit for stages that still run."""
    weight = F.when(F.col("event_type") == "purchase", 0.25).when(F.col("event_type") == "view", 0.15).when(F.col("event_type") == "click", 0.2).otherwise(0.05)
    rows = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.round(F.sum(weight * F.when(F.col("n") > 10, 1.0).otherwise(0.5)), 6).alias("progress"))


@query("""SELECT event_type AS tool, round(avg(value), 6) AS mean_q, count(*) AS n FROM events GROUP BY event_type""")
def bandit_stats(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("tool")).agg(F.round(F.avg("value"), 6).alias("mean_q"), F.count("*").alias("n"))


@query("""SELECT user_id, round(sum(0.1 * power(0.9, n - r) * value), 6) AS q FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id""")
def running_q_value(spark, d):
    """Exponential average of each user's rewards, from zero: its closed form."""
    w = Window.partitionBy("user_id")
    rows = events(spark, d).select("user_id", "value", F.row_number().over(w.orderBy("event_id")).alias("r"), F.count("*").over(w).alias("n"))
    return rows.groupBy("user_id").agg(F.round(F.sum(0.1 * F.pow(F.lit(0.9), F.col("n") - F.col("r")) * F.col("value")), 6).alias("q"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, d):
    """Tumbling hours."""
    return events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
