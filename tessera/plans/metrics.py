"""Metrics and statistics of tools, skills, samples, caches and layers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import analytics as an
from tessera.operators import quality as q
from tessera.plans.registry import query
from tessera.sources.tables import events, load

_K = "json_extract_string(props, '$.k')::INT"


@query(f"""SELECT count(*) AS activations, count(DISTINCT event_type) AS unique_skills, sum({_K})::BIGINT AS tokens_used, count(*) * 10000 - sum({_K})::BIGINT AS tokens_saved,
round((count(*) * 10000 - sum({_K})) / (count(*) * 10000.0::DOUBLE) * 100, 2) AS savings_pct, round(sum({_K}) / count(*)::DOUBLE, 2) AS avg_tokens FROM events""")
def context_efficiency(spark, d):
    """Tokens of skill activations against a baseline that has all skills on."""
    n, used = F.count("*"), F.sum("k")
    base = n * 10000
    return events(spark, d).agg(
        n.alias("activations"), F.count_distinct("event_type").alias("unique_skills"), used.alias("tokens_used"), (base - used).alias("tokens_saved"),
        F.round((base - used) / base * 100, 2).alias("savings_pct"), F.round(used / n, 2).alias("avg_tokens"),
    )


@query("""SELECT user_id, event_type AS tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id)::DOUBLE * 100, 1) AS pct FROM events GROUP BY user_id, event_type""")
def tier_selection(spark, d):
    """Selections of each tier and their share."""
    rows = events(spark, d).groupBy("user_id", F.col("event_type").alias("tier")).agg(F.count("*").alias("n"))
    return rows.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")) * 100, 1))


@query("""SELECT lang, sum(n_chars)::BIGINT AS total_tokens, count(DISTINCT source) AS document_count, round(coalesce(avg(quality), 0.72), 3) AS average_relevance, count(*) AS chunks_total, round(sum(n_chars) / 200000.0::DOUBLE * 100, 2) AS utilization
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang""")
def context_metrics(spark, d):
    """Size, sources, mean relevance of chunks that have one (0.72 if none) and use of the window, for each namespace."""
    judged = load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = load(spark, d, "documents").join(judged, "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.sum("n_chars").alias("total_tokens"), F.count_distinct("source").alias("document_count"), F.round(F.coalesce(F.avg("quality"), F.lit(0.72)), 3).alias("average_relevance"),
        F.count("*").alias("chunks_total"), F.round(F.sum("n_chars") / 200000.0 * 100, 2).alias("utilization"),
    )


@query("""SELECT conv_id, turn // 2 AS page_no, count(*) AS n, string_agg(role || ':' || turn, ',' ORDER BY turn, role) AS annotations, 595 AS width, 842 AS height FROM conversations GROUP BY conv_id, turn // 2""")
def annotations_by_page(spark, d):
    """Annotations in buckets of pages of the default size."""
    rows = load(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("page_no"))
    marks = F.array_sort(F.collect_list(F.struct("turn", "role")))
    text = F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["role"], m["turn"].cast("string"))), ",")
    return rows.agg(F.count("*").alias("n"), text.alias("annotations"), F.lit(595).alias("width"), F.lit(842).alias("height"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate, coalesce(string_agg(CASE WHEN event_type = 'error' THEN event_id END::VARCHAR, ',' ORDER BY event_id), '') AS errors FROM events GROUP BY user_id""")
def tool_results(spark, d):
    """Results of a caller's tools together: counts, success rate and the errors in order."""
    failed = F.col("event_type") == "error"
    errors = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(failed, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~failed).alias("ok"), F.round(F.count_if(~failed) / F.count("*"), 6).alias("success_rate"), errors.alias("errors"))


@query("""WITH e AS (SELECT user_id, count(*) AS all_, count(DISTINCT event_type || ':' || (event_id % 7)) AS entities, count(*) FILTER (event_type = 'purchase') AS relates, count(*) FILTER (value > 20) AS relations, count(*) FILTER (value > 20 AND event_type = 'purchase') AS plain FROM events GROUP BY user_id)
SELECT user_id, entities, relations, round(relations / entities::DOUBLE, 6) AS relation_ratio, round(CASE WHEN relations > 0 THEN (relations - plain) / relations::DOUBLE ELSE 0 END, 6) AS typed_coverage, round((all_ - entities) / all_::DOUBLE, 6) AS duplication_rate FROM e""")
def extraction_metrics(spark, d):
    """Entities, relations, their ratio, the share of typed relations, and how much deduplication removed."""
    rel, plain = F.col("value") > 20, F.col("event_type") == "purchase"
    rows = events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.concat_ws(":", "event_type", F.col("event_id") % 7)).alias("entities"), F.count_if(rel).alias("relations"), F.count_if(rel & plain).alias("plain")
    )
    typed = F.when(F.col("relations") > 0, (F.col("relations") - F.col("plain")) / F.col("relations")).otherwise(0.0)
    return rows.select(
        "user_id", "entities", "relations", F.round(F.col("relations") / F.col("entities"), 6).alias("relation_ratio"),
        F.round(typed, 6).alias("typed_coverage"), F.round((F.col("n") - F.col("entities")) / F.col("n"), 6).alias("duplication_rate"),
    )


_REASON = "CASE WHEN length(trim(text)) < 60 THEN 'question_too_short' WHEN len(string_split(text, ' ')) < 20 THEN 'few_entities' WHEN lang IS NULL OR lang = 'fr' THEN 'low_confidence' ELSE 'accepted' END"


@query(f"""SELECT source, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 6) AS share FROM (SELECT source, {_REASON} AS reason FROM documents) GROUP BY source, reason""")
def sample_gate(spark, d):
    """Samples accepted or dropped by the first reason that holds, counted for each collector."""
    reason = (
        F.when(F.length(F.trim("text")) < 60, "question_too_short")
        .when(F.size(F.split("text", " ")) < 20, "few_entities")
        .when(F.col("lang").isNull() | (F.col("lang") == "fr"), "low_confidence")
        .otherwise("accepted")
    )
    rows = load(spark, d, "documents").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("""SELECT source, round(avg(coalesce(quality, 1.0)), 6) AS mean_confidence, round(count(quality) / count(*)::DOUBLE, 6) AS evidence_coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def sample_quality(spark, d):
    """Mean confidence (missing ones count 1) and the share with evidence."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg(F.coalesce(F.col("quality").cast("double"), F.lit(1.0))), 6).alias("mean_confidence"), F.round(F.count("quality") / F.count("*"), 6).alias("evidence_coverage"))


@query(f"""WITH r AS (SELECT user_id, {_K} AS k, event_type, row_number() OVER (PARTITION BY user_id, {_K}, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, count(*) FILTER (n > 1) AS hits, count(*) FILTER (n = 1) AS misses, round(count(*) FILTER (n > 1) / count(*)::DOUBLE * 100, 2) AS hit_rate FROM r GROUP BY user_id""")
def cache_statistics(spark, d):
    """Hits and misses of a cache by key: the first request of a key misses."""
    keys = events(spark, d).groupBy("user_id", "k", "event_type").agg(F.count("*").alias("n"))
    return an.cache_stats(keys, "user_id", "n")


@query(f"""WITH s AS (SELECT user_id, {_K} AS k, max(ts) AS stored, count(*) AS accesses FROM events GROUP BY ALL), t AS (SELECT *, 3600 * 24 * 20 - date_diff('second', stored, TIMESTAMP '2024-02-01') AS ttl FROM s)
SELECT user_id, count(*) AS entries, sum(accesses)::BIGINT AS accesses, round(avg(accesses), 6) AS avg_accesses, round(avg(CASE WHEN ttl > 0 THEN ttl END), 3) AS avg_ttl, count(*) FILTER (ttl < 0) AS expired FROM t GROUP BY user_id""")
def namespace_stats(spark, d):
    """Entries of a namespace: accesses, mean time left of those that have some, and how many a sweep removes."""
    entries = an.stored_entries(events(spark, d), ["user_id", "k"], "ts", F.lit("2024-02-01").cast("timestamp"), 3600 * 24 * 20)
    return entries.groupBy("user_id").agg(
        F.count("*").alias("entries"), F.sum("accesses").alias("accesses"), F.round(F.avg("accesses"), 6).alias("avg_accesses"),
        F.round(F.avg(F.when(F.col("ttl") > 0, F.col("ttl"))), 3).alias("avg_ttl"), F.count_if(F.col("ttl") < 0).alias("expired"),
    )


@query(f"""SELECT user_id, {_K} AS k, count(*) AS accesses, max(ts) AS last_ts FROM events GROUP BY ALL HAVING 3600 * 24 * 20 - date_diff('second', max(ts), TIMESTAMP '2024-02-01') >= 0""")
def live_entries(spark, d):
    """Entries that are not older than their time to live, with tracked accesses."""
    entries = an.stored_entries(events(spark, d), ["user_id", "k"], "ts", F.lit("2024-02-01").cast("timestamp"), 3600 * 24 * 20)
    return entries.filter("ttl >= 0").select("user_id", "k", "accesses", F.col("stored").alias("last_ts"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>', 1))::BIGINT AS level FROM pages)
SELECT level, count(*) AS n, count(DISTINCT page_id) AS pages, round(coalesce(avg(level), 0), 6) AS mean_level FROM h GROUP BY level""")
def section_levels(spark, d):
    """How many sections each level has, in how many pages."""
    rows = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<h([1-6])[^>]*>"), F.lit(1))).alias("level")).withColumn("level", F.col("level").cast("long"))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.round(F.coalesce(F.avg("level"), F.lit(0.0)), 6).alias("mean_level"))


@query("""SELECT conv_id, n, round(avg_length, 6) AS avg_length, round(least(n / 3.0::DOUBLE, 1.0) * 0.5 + distinct_ / n::DOUBLE * 0.5, 6) AS quality FROM (SELECT conv_id, count(*) AS n, avg(length(text)) AS avg_length, count(DISTINCT text) AS distinct_ FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def plan_quality(spark, d):
    """Coverage (three queries or more) and diversity of a plan's queries."""
    rows = load(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("a"), F.count_distinct("text").alias("u"))
    return rows.select("conv_id", "n", F.round("a", 6).alias("avg_length"), F.round(F.least(F.col("n") / 3.0, F.lit(1.0)) * 0.5 + F.col("u") / F.col("n") * 0.5, 6).alias("quality"))


@query("""SELECT conv_id, turn, round(CASE WHEN l > 500 THEN 0.3 WHEN l > 200 THEN 0.15 ELSE 0 END + CASE WHEN c > 0 THEN 0.2 + CASE WHEN c / greatest(n, 1)::DOUBLE > 0.3 THEN 0.2 ELSE 0 END ELSE 0 END + CASE WHEN n >= 10 THEN 0.3 WHEN n >= 5 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS quality
FROM (SELECT conv_id, turn, length(text) AS l, turn % 4 AS c, turn * 2 AS n FROM conversations WHERE role = 'assistant')""")
def synthesis_quality(spark, d):
    """Points of an answer for its length, its citations and its contexts."""
    rows = load(spark, d, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", F.round(q.synthesis_quality(F.length("text"), F.col("turn") % 4, F.col("turn") * 2), 6).alias("quality"))


@query("SELECT 'short' AS layer, count(*) AS n, round(avg(value), 6) AS mean FROM events UNION ALL SELECT 'vector', count(*), round(avg(label), 6) FROM embeddings UNION ALL SELECT 'episodes', count(*), round(avg(turn), 6) FROM conversations")
def layer_metrics(spark, d):
    """Gauges of the memory layers."""
    parts = [("short", events(spark, d), "value"), ("vector", load(spark, d, "embeddings"), "label"), ("episodes", load(spark, d, "conversations"), "turn")]
    out = None
    for name, rows, value in parts:
        one = rows.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).select(F.lit(name).alias("layer"), "n", "mean")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_type, p_brand, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, p_type, p_brand) AS place FROM part GROUP BY p_type, p_brand")
def frequency_batches(spark, d):
    """Groups in order of size, ranked over range partitions."""
    rows = load(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    ranked = an.ranks(rows.withColumns({"_g": F.lit(0), "_o": -F.col("n")}), ["_g"], "_o", "p_type", "p_brand")
    return ranked.select("p_type", "p_brand", "n", F.col("_r").alias("place"))


@query()
def budget_rebalance(spark, d):
    """Skills' budgets shrunk where little is used and grown in order while tokens are left; tests compare a loop."""
    rows = events(spark, d).groupBy(F.col("user_id").alias("manager"), F.col("event_type").alias("skill")).agg(F.sum("k").alias("used"))
    rows = rows.withColumn("allocated", F.when(F.length("skill") > 5, 4000).otherwise(900).cast("long"))
    return an.rebalance(rows, "manager", "skill", 20000)


_GRID = "list_transform(string_split({0}, chr(10)), lambda r: string_split(r, ' '))"


@query(f"""WITH g AS (SELECT conv_id, turn, {_GRID.format('text')} AS a, {_GRID.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations),
n AS (SELECT *, len(a) AS ra, len(b) AS rb, list_max(list_transform(a, lambda r: len(r))) AS ca, list_max(list_transform(b, lambda r: len(r))) AS cb,
list_distinct(list_filter(list_transform(flatten(a), lambda c: lower(trim(c))), lambda c: c <> '')) AS xa, list_distinct(list_filter(list_transform(flatten(b), lambda c: lower(trim(c))), lambda c: c <> '')) AS xb FROM g WHERE b IS NOT NULL)
SELECT conv_id, turn, round(0.3::DOUBLE * ((least(ra, rb) / greatest(ra, rb)::DOUBLE + least(ca, cb) / greatest(ca, cb)::DOUBLE) / 2) + 0.5::DOUBLE * (len(list_intersect(xa, xb)) / len(list_distinct(list_concat(xa, xb)))::DOUBLE)
 + 0.2::DOUBLE * (len(list_filter(range(1, least(len(a[1]), len(b[1])) + 1), lambda i: lower(trim(a[1][i])) = lower(trim(b[1][i])))) / greatest(len(a[1]), len(b[1]))::DOUBLE), 6) AS agreement FROM n""")
def grid_agreement(spark, d):
    """How far two readings of a table agree: here each turn's lines and words against the turn before."""
    grid = lambda c: F.transform(F.split(c, "\n"), lambda r: F.split(r, " "))
    rows = load(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(q.grid_agreement(grid(F.col("text")), grid(F.col("before"))), 6).alias("agreement"))


_WIDE = "list_max(list_transform(string_split(text, chr(10)), lambda r: len(string_split(r, ' '))))"


@query(f"""WITH g AS (SELECT conv_id, turn, role, len(string_split(text, chr(10))) AS r, {_WIDE} AS c FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS other, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.r - b.r) + abs(a.c - b.c), b.turn) AS k FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, other FROM p WHERE k = 1""")
def grid_best_match(spark, d):
    """The candidate table nearest in rows and columns, the first of equals."""
    grid = F.transform(F.split("text", "\n"), lambda r: F.split(r, " "))
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", *[c.alias(n) for c, n in zip(q.grid_size(grid), ("r", "c"))])
    mine, theirs = rows.filter("role = 'user'"), rows.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("other"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    far = F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("c") - F.col("c2"))
    return mine.join(theirs, "conv_id").groupBy("conv_id", "turn").agg(F.min(F.struct(far.alias("far"), "other"))["other"].alias("other"))


@query("SELECT conv_id, turn, score, score BETWEEN 0.5 AND 0.85 AS again, turn % 4 < 3 AS retry FROM (SELECT conv_id, turn, round(length(text) % 100 / 100.0::DOUBLE, 2) AS score FROM conversations)")
def cross_validation_gate(spark, d):
    """Which tables are read twice, and which failed jobs are tried again (fewer than three times so far)."""
    score = F.round(F.length("text") % 100 / 100.0, 2)
    rows = load(spark, d, "conversations").select("conv_id", "turn", score.alias("score"), (F.col("turn") % 4 < 3).alias("retry"))
    return rows.withColumn("again", q.cross_validate(F.col("score")))


@query("SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(1.19 AS DECIMAL(4, 2)))::VARCHAR AS gross, min(o_orderdate + INTERVAL 30 DAY) AS due FROM orders GROUP BY o_orderpriority")
def decimal_intervals(spark, d):
    """Exact decimals and interval arithmetic."""
    gross = F.sum(F.col("o_totalprice").cast("decimal(18,2)") * F.lit("1.19").cast("decimal(4,2)"))
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(gross.cast("string").alias("gross"), F.min(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type")
def approx_distinct(spark, d):
    """Distinct users exactly, and whether the sketch's count is within a tenth."""
    exact, near = F.count("user_id"), F.approx_count_distinct("user_id", 0.02)
    users = load(spark, d, "events").select("event_type", "user_id").distinct()  # else each user's row would carry a sketch
    return users.groupBy("event_type").agg(exact.alias("users"), (F.abs(exact - near) <= 0.1 * exact).alias("near"))


@query("""SELECT event_id, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind, lead(value, 1, 0.0) OVER w AS next_value, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_functions(spark, d):
    """Quarters, dense ranks, the next value and a moving mean."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select(
        "event_id", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind"),
        F.lead("value", 1, 0.0).over(w).alias("next_value"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"),
    )
