"""Scalar scores over events, and small ordered computations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scores as sc
from tessera.plans.registry import query
from tessera.sources.tables import events, load

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("SELECT event_id, round(CASE WHEN event_type <> 'error' AND value < 20 THEN 0.5 * (1 - value / 20.0) ELSE 0.0 END, 6)::DOUBLE AS efficiency, round((CASE WHEN event_type <> 'error' THEN 1.0 ELSE -1.0 END) + (CASE WHEN event_type <> 'error' AND value < 20 THEN 0.5 * (1 - value / 20.0) ELSE 0.0 END) + 0.5 * (user_id % 10) / 10.0::DOUBLE, 6)::DOUBLE AS reward FROM events")
def rewards(spark, d):
    """Efficiency and total reward of each run."""
    fine = F.col("event_type") != "error"
    quality = F.col("user_id") % 10 / 10.0
    return events(spark, d).select(
        "event_id", F.round(sc.efficiency_reward(fine, F.col("value"), 20.0), 6).alias("efficiency"), F.round(sc.reward(fine, F.col("value"), 20.0, quality, F.lit(0.0)), 6).alias("reward")
    )


@query(f"""SELECT event_id, round(greatest(0.0, least(1.0, coalesce(0.2 + CASE WHEN event_type = 'purchase' THEN (user_id % 5) / 5.0::DOUBLE END * 0.8 * 0.8, 0.5 + CASE WHEN event_type = 'click' THEN 0.3 ELSE 0.0 END + least(0.5, {_K} / 240.0::DOUBLE)) + CASE WHEN user_id % 7 = 0 THEN 0.4 ELSE 0.0 END)), 6)::DOUBLE AS relevance FROM events""")
def relevance_signals(spark, d):
    """Relevance from clicks, dwell time, ratings and citations."""
    rating = F.when(F.col("event_type") == "purchase", F.col("user_id") % 5 / 5.0)
    score = sc.relevance_of_signals(F.col("event_type") == "click", F.col("k"), rating, F.col("user_id") % 7 == 0)
    return events(spark, d).select("event_id", F.round(score, 6).alias("relevance"))


@query(f"SELECT event_id, round(CASE WHEN value > 5 THEN 0.3 ELSE 0 END + CASE WHEN {_K} > 50 THEN 0.3 ELSE 0 END + CASE WHEN event_type = 'view' THEN 0.2 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS quality FROM events")
def event_quality(spark, d):
    """A sum of boolean features."""
    score = sc.features_score((F.col("value") > 5, 0.3), (F.col("k") > 50, 0.3), (F.col("event_type") == "view", 0.2), (F.col("user_id") % 2 == 0, 0.2))
    return events(spark, d).select("event_id", F.round(score, 6).alias("quality"))


@query(f"SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' AND event_type = 'view' AND value <> 0 AND {_K} <> 0 AND user_id <> 0")
def rerank_pairs(spark, d):
    """Training pairs whose five fields are all there; a zero score drops a row (kept from the source's rule)."""
    rows = events(spark, d).filter(F.col("ts").between("2024-01-03", "2024-01-25") & (F.col("event_type") == "view"))
    return rows.filter((F.col("value") != 0) & (F.col("k") != 0) & (F.col("user_id") != 0)).select("event_id", "user_id", "event_type", "value")


@query(f"SELECT event_id, round(CASE WHEN {_K} >= 5 THEN value / ({_K} / 100.0::DOUBLE) - value ELSE 0.0 END, 6)::DOUBLE AS eta, CASE WHEN value < 5 THEN 'fast' WHEN value < 20 THEN 'balanced' ELSE 'quality' END AS size_class, CASE WHEN {_K} < 100 * 0.25 THEN 'start' WHEN {_K} > 100 * 0.75 THEN 'end' ELSE 'middle' END AS position_ FROM events")
def progress_scores(spark, d):
    """Remaining time, size class and position."""
    return events(spark, d).select(
        "event_id", F.round(sc.remaining_ms(F.col("value"), F.col("k")), 6).alias("eta"), sc.model_size(F.col("value")).alias("size_class"), sc.position(F.col("k"), F.lit(100)).alias("position_")
    )


@query("WITH r AS (SELECT s_nationkey, count(*) / count(DISTINCT l_suppkey)::DOUBLE AS ratio FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey) SELECT s_nationkey, round(ratio, 6) AS ratio, round(CASE WHEN ratio < 590 THEN ratio / 590 WHEN ratio > 610 THEN 610 / ratio ELSE 1.0 END, 6)::DOUBLE AS score, CASE WHEN ratio < 590 THEN 'below' WHEN ratio > 610 THEN 'above' ELSE 'within' END AS verdict FROM r")
def connectivity_score(spark, d):
    """Relations for each entity against a benchmark's range."""
    rows = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ratio = rows.groupBy("s_nationkey").agg((F.count("*") / F.count_distinct("l_suppkey")).alias("r"))
    verdict = F.when(F.col("r") < 590, "below").when(F.col("r") > 610, "above").otherwise("within")
    return ratio.select("s_nationkey", F.round("r", 6).alias("ratio"), F.round(sc.connectivity(F.col("r"), 590, 610), 6).alias("score"), verdict.alias("verdict"))


@query("SELECT user_id, event_id, round(1 / (1 + i)::DOUBLE, 6) AS score FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i < 10")
def fallback_ranking(spark, d):
    """1 / (1 + place) for the first ten."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events(spark, d).withColumn("i", i).filter("i < 10").select("user_id", "event_id", F.round(1 / (1 + F.col("i")), 6).alias("score"))


@query("SELECT user_id, event_id, greatest(0.0, least(value, 100 - before))::DOUBLE AS taken FROM (SELECT user_id, event_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) WHERE before < 100")
def priority_reclaim(spark, d):
    """From the lowest priority up, what each gives until the need is met."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, d).withColumn("before", F.coalesce(F.sum("value").over(w), F.lit(0.0))).filter("before < 100")
    return rows.select("user_id", "event_id", F.greatest(F.lit(0.0), F.least(F.col("value"), 100 - F.col("before"))).alias("taken"))


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def pagination(spark, d):
    """The third page of 25 rows in a total order."""
    return events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(25).select("event_id", "ts", "value")


@query("SELECT user_id, arg_max(event_type, (q, -k)) AS best_tool, max(q) AS q FROM (SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(value))::DOUBLE AS q, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS k FROM events GROUP BY ALL) GROUP BY user_id")
def best_tool(spark, d):
    """The tool of the highest mean value, the first on ties; sums are exact, in hundredths, so that means compare alike anywhere."""
    k = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 3).otherwise(4)
    rows = events(spark, d).groupBy("user_id", "event_type").agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / (100 * F.count("value")).cast("double")).alias("q"))
    best = F.max(F.struct("q", (-k).alias("k"), "event_type"))
    return rows.groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_type").alias("best_tool"), F.col("b.q").alias("q"))


@query("SELECT doc_id, score, doc_id <> 0 AND score >= 0.5 AS keep FROM (SELECT doc_id, round(coalesce((least(n_chars / 5000.0::DOUBLE, 1.0) + CASE WHEN lang = 'en' THEN 0.8::DOUBLE END) / 2, least(n_chars / 5000.0::DOUBLE, 1.0)), 6) AS score FROM documents)")
def score_blend(spark, d):
    """The mean of two scores, or the one that is there."""
    a, b = F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), F.when(F.col("lang") == "en", 0.8)
    rows = load(spark, d, "documents").select("doc_id", F.round(sc.blend(a, b), 6).alias("score"))
    return rows.withColumn("keep", (F.col("doc_id") != 0) & (F.col("score") >= 0.5))
