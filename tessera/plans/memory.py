"""Memory queries: events are facts, users their namespaces, value / 100 the importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import memory as me
from tessera.plans.registry import query
from tessera.sources.tables import events, load

_DAYS = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE"


def now():
    return F.lit("2024-02-01").cast("timestamp")


@query(f"SELECT event_id, round(power(2.0::DOUBLE, -({_DAYS}) / 30), 6) AS decay, round(value / 100 * power(2.0::DOUBLE, -({_DAYS}) / 30), 6) AS effective FROM events")
def memory_decay(spark, d):
    """Half-life decay and effective importance."""
    decay = me.half_life(me.age_days(F.col("ts"), now()), 30)
    return events(spark, d).select("event_id", F.round(decay, 6).alias("decay"), F.round(F.col("value") / 100 * decay, 6).alias("effective"))


@query(f"SELECT event_id, value / 100 * power(2.0::DOUBLE, -({_DAYS}) / 30) < 0.3 AS forget FROM events")
def should_forget(spark, d):
    return events(spark, d).select("event_id", me.should_forget(F.col("value") / 100, F.col("ts"), now()).alias("forget"))


@query(f"SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-25' AND value / 100 * power(2.0::DOUBLE, -({_DAYS}) / 30) < 0.3")
def stale_facts(spark, d):
    """Old facts of little effective importance."""
    rows = events(spark, d).filter(F.col("ts") <= "2024-01-25")
    return rows.filter(me.should_forget(F.col("value") / 100, F.col("ts"), now())).select("event_id", "user_id")


@query("""SELECT user_id, n, round(CASE WHEN n > 0 THEN least(1.0, ln(n + 1) / ln(101)) ELSE 0 END, 6) AS frequency, round(1 - 1 / (1 + power(n / 20.0::DOUBLE, 2)), 6) AS saturation FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
def access_frequency(spark, d):
    rows = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", "n", F.round(me.access_frequency(F.col("n")), 6).alias("frequency"), F.round(me.frequency(F.col("n")), 6).alias("saturation"))


@query(f"""SELECT user_id, round(0.3 * least(1.0, ln(n + 1) / ln(101)) + 0.4 * power(2.0::DOUBLE, -days / 30) + 0.3 * rating, 6) AS score FROM (
SELECT user_id, count(*) AS n, min({_DAYS}) AS days, coalesce(avg(value) FILTER (event_type = 'purchase') / 100, 0.5) AS rating FROM events GROUP BY user_id)""")
def access_relevance(spark, d):
    """Frequency, recency and rating of each memory."""
    rows = events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("n"), F.min(me.age_days(F.col("ts"), now())).alias("days"), (F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))) / 100).alias("rating")
    )
    return rows.select("user_id", F.round(me.access_relevance(F.col("n"), F.col("days"), F.col("rating")), 6).alias("score"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= greatest(1, floor(n * 0.2))""")
def evict_20pct(spark, d):
    """The least used fifth of each namespace."""
    return me.evict(events(spark, d), "user_id", 0.2, F.col("value"), F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY value, event_id LIMIT 100)")
def forget_least_important(spark, d):
    """The facts that stay when the hundred least important ones are deleted."""
    rows = events(spark, d)
    least = rows.orderBy("value", "event_id").limit(100).select("event_id")
    return rows.join(F.broadcast(least), "event_id", "left_anti").select("event_id", "user_id")  # a hundred rows


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n >= 60 ORDER BY n DESC, user_id LIMIT 20")
def frequently_accessed(spark, d):
    rows = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 60")
    return rows.orderBy(F.desc("n"), "user_id").limit(20)


_W = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH f AS (SELECT conv_id, turn, {_W} AS ws FROM conversations),
j AS (SELECT a.conv_id, a.turn, max(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE) AS m FROM f a LEFT JOIN f b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL)
SELECT conv_id, turn, round(1 - coalesce(m, 0), 6) AS novelty FROM j""")
def novelty(spark, d):
    """1 - the largest word overlap with an earlier fact of the same conversation."""
    facts = load(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(tx.words(F.col("text"))).alias("ws"))
    earlier = facts.select("conv_id", F.col("turn").alias("t"), F.col("ws").alias("es"))
    both = facts.join(earlier, "conv_id").filter("t < turn").groupBy("conv_id", "turn").agg(F.max(tx.jaccard(F.col("ws"), F.col("es"))).alias("m"))
    out = facts.join(both, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.round(1 - F.coalesce("m", F.lit(0.0)), 6).alias("novelty"))


@query(f"""SELECT conv_id, turn, round(0.3 * len(ws) / 100.0::DOUBLE + 0.3 * least(1.0, length(text) / 1000.0::DOUBLE) + 0.2 * (1 - 1 / (1 + power((turn + 1) / 20.0::DOUBLE, 2))) + 0.2 * 0.5, 6) AS importance FROM (SELECT conv_id, turn, text, {_W} AS ws FROM conversations)""")
def importance(spark, d):
    """A weighted sum of four features; missing recency counts half."""
    size = F.size(F.array_distinct(tx.words(F.col("text"))))
    score = 0.3 * size / 100.0 + 0.3 * F.least(F.lit(1.0), F.length("text") / 1000.0) + 0.2 * me.frequency(F.col("turn") + 1) + F.lit(0.2) * 0.5
    return load(spark, d, "conversations").select("conv_id", "turn", F.round(score, 6).alias("importance"))


@query("""SELECT user_id, event_type, string_agg(event_id::VARCHAR, '|' ORDER BY event_id) AS merged, round(avg(value), 9) AS mean, min(ts) AS first_ts FROM events GROUP BY ALL""")
def fact_consolidation(spark, d):
    """A cluster's facts as one: joined, mean importance, first time."""
    rows = events(spark, d)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), "|")
    return rows.groupBy("user_id", "event_type").agg(ids.alias("merged"), F.round(F.avg("value"), 9).alias("mean"), F.min("ts").alias("first_ts"))


@query("""SELECT user_id, total, CASE WHEN total >= 900 THEN 'accept_full' WHEN total >= 500 THEN 'accept' ELSE 'reject' END AS decision FROM (SELECT user_id, round(sum(value), 4) AS total FROM events WHERE event_type = 'view' GROUP BY user_id)""")
def write_policy(spark, d):
    rows = events(spark, d).filter("event_type = 'view'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return rows.withColumn("decision", F.when(F.col("total") >= 900, "accept_full").when(F.col("total") >= 500, "accept").otherwise("reject"))


@query("""SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING list_has_any(list(role), ['user']) AND min(turn) = 0""")
def tag_search(spark, d):
    """Groups that hold any of the tags."""
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_set("role").alias("tags"), F.min("turn").alias("t"))
    return rows.filter(F.arrays_overlap("tags", F.array(F.lit("user"))) & (F.col("t") == 0)).select("conv_id", "n")
