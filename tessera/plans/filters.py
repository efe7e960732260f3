"""Predicates, scans and tenant scoping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import filters as fl
from tessera.plans.registry import query
from tessera.sources.tables import events, load


@query("""SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'
AND event_type IN ('view', 'click') AND NOT (coalesce(user_id IN (1, 2, 3), false))""")
def metadata_filter(spark, d):
    """Inclusive dates, kinds wanted, sources unwanted (a missing source passes)."""
    wanted = fl.MetadataFilter(created_after="2024-01-05", created_before="2024-01-20", kind_in=("view", "click"), source_not_in=(1, 2, 3))
    rows = events(spark, d)
    return rows.filter(wanted.column(created="ts", kind="event_type", source="user_id")).select("event_id", "event_type", "value")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def tenant_filter(spark, d):
    """Only rows of the allowed namespaces."""
    return fl.scoped(load(spark, d, "documents"), ["src1", "src2"], "source").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE false")
def tenant_filter_empty(spark, d):
    """An empty list of namespaces gives no rows."""
    return fl.scoped(load(spark, d, "documents"), [], "source").select("doc_id", "source")


@query("""SELECT conv_id, turn, coalesce(nullif(role, 'assistant'), 'default') AS ns FROM conversations WHERE coalesce(nullif(role, 'assistant'), 'default') IN ('default')""")
def keyword_post_filter(spark, d):
    """Rows without a namespace belong to the default one."""
    rows = load(spark, d, "conversations").withColumn("ns", F.when(F.col("role") != "assistant", F.col("role")))
    return fl.scoped(rows, ["default"], "ns", default="default").select("conv_id", "turn", F.coalesce("ns", F.lit("default")).alias("ns"))


@query("""SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' AND event_type = 'error' ORDER BY event_id LIMIT 50""")
def audit_query(spark, d):
    """The first 50 events of a range and kind, in insertion order."""
    rows = events(spark, d).filter((F.col("ts") >= "2024-01-10") & (F.col("ts") <= "2024-01-12") & (F.col("event_type") == "error"))
    return rows.orderBy("event_id").limit(50).select("event_id", "ts", "event_type")


@query("""SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'withdrawn' WHEN ts + INTERVAL 20 DAY < TIMESTAMP '2024-02-01' THEN 'expired' ELSE 'granted' END AS status,
(event_type <> 'error' AND ts + INTERVAL 20 DAY >= TIMESTAMP '2024-02-01') AS valid FROM events""")
def consent_status(spark, d):
    """Withdrawn before expired before granted; valid if neither."""
    rows = events(spark, d).withColumn("expires", F.col("ts") + F.expr("INTERVAL 20 DAYS"))
    status = fl.consent_status(F.col("event_type") == "error", F.col("expires"), F.lit("2024-02-01").cast("timestamp"))
    return rows.select("user_id", "event_id", status.alias("status"), (status == "granted").alias("valid"))


@query("""SELECT user_id, count(*) AS n_missing FROM (SELECT DISTINCT u.user_id, r.t FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['view', 'purchase', 'error']) AS t) r
EXCEPT SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-28') GROUP BY user_id""")
def consent_gaps(spark, d):
    """Users that lack a required category among their recent consents."""
    rows = events(spark, d)
    given = F.collect_set(F.when(F.col("ts") >= "2024-01-28", F.col("event_type")))
    missing = F.size(F.array_except(F.array(*[F.lit(x) for x in ("view", "purchase", "error")]), "given"))
    return rows.groupBy("user_id").agg(given.alias("given")).select("user_id", missing.cast("long").alias("n_missing")).filter("n_missing > 0")


@query("""SELECT doc_id, CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) > 2000 THEN 'long' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 20 THEN 'few_words' ELSE 'ok' END AS reason FROM documents""")
def sample_validity(spark, d):
    """Why a sample is refused: the first reason wins."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    reason = F.when(F.length("text") < 50, "short").when(F.length("text") > 2000, "long").when(n < 20, "few_words").otherwise("ok")
    return load(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(create|merge|delete|set|remove)\\b') AS is_write FROM conversations""")
def write_query_detect(spark, d):
    """Whether a text holds a word that writes."""
    return load(spark, d, "conversations").select("conv_id", "turn", fl.is_write(F.col("text")).alias("is_write"))


@query("""SELECT user_id, event_type, n, CASE WHEN user_id = 0 THEN 'admin' WHEN event_type = 'error' THEN 'denied' WHEN event_type IN ('view', 'click') THEN 'allowed' WHEN n > 10 THEN 'rate_limited' ELSE 'default' END AS decision
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def tool_access(spark, d):
    """Admin, denied list, allow list, rule, default - in this order."""
    rows = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    decision = fl.access_decision(F.col("user_id") == 0, F.col("event_type") == "error", F.col("event_type").isin("view", "click"), F.col("n") > 10)
    return rows.withColumn("decision", decision)


@query("""SELECT source, count(*) AS n, CASE WHEN source IN ('src0') THEN 'general' WHEN starts_with(source, 'src1') THEN 'project' ELSE 'custom' END AS kind FROM documents GROUP BY source""")
def namespace_listing(spark, d):
    """Rows of each namespace and its kind by prefix."""
    kind = fl.namespace_kind(F.col("source"), {"src1": "project"}, general=("src0",))
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("kind", kind)


@query("SELECT doc_id, source, lang FROM documents WHERE source <> 'src3'")
def namespace_delete(spark, d):
    """All rows but those of one tenant."""
    return fl.delete_where(load(spark, d, "documents"), F.col("source") == "src3").select("doc_id", "source", "lang")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark, d):
    """Of rows with one key the last written stays."""
    return fl.last_wins(events(spark, d), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def stable_entities(spark, d):
    """Entities without a change since a date."""
    recent = load(spark, d, "orders").filter(F.col("o_orderdate") >= "1998-01-01")
    return load(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT user_id, event_id FROM events WHERE list_has_all(['click', 'view'], [event_type]) AND (value > 5 OR value IS NULL) AND user_id BETWEEN 10 AND 20""")
def filter_compile(spark, d):
    """A conjunction of must clauses with tags, range and namespace."""
    tags = fl.MetadataFilter(kind_in=("click", "view")).column(kind="event_type")
    return events(spark, d).filter(tags & (F.col("value") > 5) & F.col("user_id").between(10, 20)).select("user_id", "event_id")


