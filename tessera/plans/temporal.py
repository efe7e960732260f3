"""Versioning queries: a user's events are the versions of an entity; transactions lag a day behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import temporal as tp
from tessera.plans.registry import query
from tessera.sources.tables import events, load

_V = """v AS (SELECT user_id, event_id, event_type, value, row_number() OVER w AS version, ts AS valid_from, lead(ts) OVER w AS valid_to,
ts + INTERVAL 1 DAY AS transaction_from, lead(ts) OVER w + INTERVAL 1 DAY AS transaction_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def versions(spark, d):
    rows = tp.scd2(events(spark, d).select("user_id", "event_id", "event_type", "value", "ts"), "user_id", "ts", "event_id").drop("ts")
    day = F.expr("INTERVAL 1 DAY")
    return rows.withColumns({"transaction_from": F.col("valid_from") + day, "transaction_to": F.col("valid_to") + day})


_T = "TIMESTAMP '2024-01-15'"
_U = "TIMESTAMP '2024-01-17'"


@query(f"WITH {_V} SELECT * FROM v")
def scd2_versions(spark, d):
    """States as versions with validity and transaction intervals."""
    return versions(spark, d)


@query(f"WITH {_V} SELECT user_id, event_id, version FROM v WHERE valid_from <= {_T} AND (valid_to > {_T} OR valid_to IS NULL) AND transaction_from <= {_T} AND (transaction_to > {_T} OR transaction_to IS NULL)")
def as_of(spark, d):
    return versions(spark, d).filter(tp.as_of(tp.instant("2024-01-15"))).select("user_id", "event_id", "version")


@query(f"WITH {_V} SELECT user_id, event_id, version FROM v WHERE valid_from <= {_U} AND (valid_to >= {_T} OR valid_to IS NULL) AND transaction_from <= {_U} AND (transaction_to >= {_T} OR transaction_to IS NULL)")
def between_both(spark, d):
    return versions(spark, d).filter(tp.between(tp.instant("2024-01-15"), tp.instant("2024-01-17"))).select("user_id", "event_id", "version")


@query(f"WITH {_V} SELECT user_id, event_id FROM v WHERE valid_from <= {_U} AND (valid_to >= {_T} OR valid_to IS NULL)")
def valid_overlap(spark, d):
    return versions(spark, d).filter(tp.overlaps(tp.instant("2024-01-15"), tp.instant("2024-01-17"))).select("user_id", "event_id")


@query(f"WITH {_V} SELECT user_id, event_id FROM v WHERE transaction_from <= {_U} AND (transaction_to >= {_T} OR transaction_to IS NULL)")
def transaction_during(spark, d):
    rows = versions(spark, d)
    return rows.filter(tp.overlaps(tp.instant("2024-01-15"), tp.instant("2024-01-17"), "transaction_from", "transaction_to")).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def current_versions(spark, d):
    return versions(spark, d).filter(tp.current()).select("user_id", "event_id")


@query(f"WITH {_V} SELECT user_id, max(version) AS version FROM v WHERE valid_from <= {_T} AND (valid_to > {_T} OR valid_to IS NULL) AND transaction_from <= {_U} GROUP BY user_id")
def point_in_time(spark, d):
    """Separate instants for validity and knowledge, latest version."""
    rows = versions(spark, d).filter(tp.at(tp.instant("2024-01-15")) & (F.col("transaction_from") <= tp.instant("2024-01-17")))
    return tp.latest(rows, "user_id").select("user_id", "version")


@query(f"WITH {_V}, p AS (SELECT *, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY version)) SELECT user_id, version, concat_ws(',', CASE WHEN version = 1 OR event_type IS DISTINCT FROM t0 THEN 'event_type' END, CASE WHEN version = 1 OR value IS DISTINCT FROM v0 THEN 'value' END) AS changed, CASE WHEN version = 1 THEN 'create' ELSE 'update' END AS kind FROM p")
def version_diff(spark, d):
    """What each version changed."""
    return tp.changed_fields(versions(spark, d), "user_id", "version", ["event_type", "value"]).select("user_id", "version", "changed", "kind")


@query("""WITH s AS (SELECT unnest(string_split(concat_ws(',', CASE WHEN event_type IS DISTINCT FROM t0 THEN 'event_type' END, CASE WHEN value IS DISTINCT FROM v0 THEN 'value' END), ',')) AS f FROM (
SELECT event_type, value, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r > 1) SELECT f AS field, count(*) AS n FROM s WHERE f <> '' GROUP BY f""")
def changed_field_counts(spark, d):
    """Which fields change most."""
    rows = tp.changed_fields(versions(spark, d), "user_id", "version", ["event_type", "value"]).filter("kind = 'update' AND changed <> ''")
    return rows.select(F.explode(F.split("changed", ",")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query(f"WITH {_V} SELECT user_id, version, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY version DESC) > 10 AND transaction_to IS NULL THEN TIMESTAMP '2024-02-01' ELSE transaction_to END AS transaction_to FROM v")
def retention_close(spark, d):
    """Versions beyond the last ten are closed."""
    return tp.retain(versions(spark, d), "user_id", 10, tp.instant("2024-02-01")).select("user_id", "version", "transaction_to")


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, l.user_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_section(spark, d):
    """Each click with its user's last view before: an as-of join."""
    rows = events(spark, d)
    left = rows.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = rows.filter("event_type = 'view'").select("user_id", "ts", "value")
    return tp.asof_join(left, right, "user_id", "ts", "value").select("event_id", "user_id", "value")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, status_before, o_totalprice - price_before AS price_step FROM (
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, lag(o_orderstatus) OVER w AS status_before, lag(o_totalprice) OVER w AS price_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def evolution_timeline(spark, d):
    """Each state beside the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = load(spark, d, "orders").withColumns({"status_before": F.lag("o_orderstatus").over(w), "step": F.col("o_totalprice") - F.lag("o_totalprice").over(w)})
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus", "status_before", F.col("step").alias("price_step"))


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def retention_purge(spark, d):
    """What a purge keeps."""
    return events(spark, d).filter(F.col("ts") >= "2024-01-20").select("event_id", "user_id", "ts")


@query("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def entity_history(spark, d):
    """The five last changes of each entity."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("user_id", "event_id", "ts", "event_type")
