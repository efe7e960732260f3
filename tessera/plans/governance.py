"""Governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import governance as gv
from tessera.operators.filters import delete_where
from tessera.plans.registry import query
from tessera.sources.tables import events, load

def _all(*families):
    return "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for f in families for p in gv.FAMILIES[f]) + ", CAST([] AS VARCHAR[]))))"


@query("SELECT doc_id, " + ", ".join(f"array_to_string({_all(*fs)}, ';') AS {name}" for name, fs in gv.CATEGORIES.items()) + " FROM documents")
def pii_detect(spark, d):
    """Sorted distinct matches of each category."""
    return load(spark, d, "documents").select("doc_id", *[F.array_join(gv.category(F.col("text"), c), ";").alias(c) for c in gv.CATEGORIES])


@query("SELECT doc_id, " + ", ".join(f"len({_all(f)})::BIGINT AS {f}" for f in gv.FAMILIES if f != "card") + " FROM documents")
def pii_families(spark, d):
    """Distinct matches of each family."""
    return load(spark, d, "documents").select("doc_id", *[F.size(gv.detected(F.col("text"), f)).cast("long").alias(f) for f in gv.FAMILIES if f != "card"])


_DIGIT = "substr(dg, length(dg) - i::INT, 1)::INT"


@query(f"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{gv.FAMILIES["card"][0]}')) AS card FROM documents), g AS (SELECT doc_id, card, regexp_replace(card, '[ -]', '', 'g') AS dg FROM m WHERE regexp_matches(regexp_replace(card, '[ -]', '', 'g'), '^[0-9]+$')),
x AS (SELECT doc_id, card, dg, unnest(range(0, length(dg)::BIGINT)) AS i FROM g),
s AS (SELECT doc_id, card, sum(CASE WHEN i % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END) AS t FROM x GROUP BY ALL)
SELECT doc_id, card FROM s WHERE t % 10 = 0""")
def card_luhn(spark, d):
    """Card numbers that pass the mod-10 check."""
    return load(spark, d, "documents").select("doc_id", F.explode(gv.detected(F.col("text"), "card")).alias("card"))


_RED = "text"
for _f in ("email", "ssn", "tax", "card", "iban", "ipv6", "ipv4"):
    for _p in gv.FAMILIES[_f]:
        _RED = f"regexp_replace({_RED}, '{_p}', '[{_f.upper()}]', 'g')"


@query(f"SELECT doc_id, {_RED} AS redacted FROM documents")
def redact(spark, d):
    return load(spark, d, "documents").select("doc_id", gv.redacted(F.col("text")).alias("redacted"))


_CHAIN = """o AS (SELECT user_id, event_id, event_id || ':' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
c AS (SELECT user_id, event_id, rn, '' AS prev, sha256(payload) AS hash FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.event_id, o.rn, c.hash, sha256(o.payload || c.hash) FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, prev, hash FROM c")
def audit_chain(spark, d):
    """Hash chain of each actor's events: every hash covers all before it."""
    return gv.chained(events(spark, d), "user_id", ["event_id"], audit_payload()).select("user_id", "event_id", "prev", "hash")


def audit_payload():
    return F.concat_ws(":", F.col("event_id").cast("string"), "event_type")


@query("""SELECT user_id, event_id, CASE WHEN event_id % 971 = 0 THEN 'hash' ELSE 'link' END AS why FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE event_id % 971 = 0 OR (before % 977 = 0 AND before % 971 <> 0)""")
def audit_breaks(spark, d):
    """Where a chain is broken: at events changed since, and behind events changed together with their hash."""
    chain = gv.chained(events(spark, d), "user_id", ["event_id"], audit_payload())
    plain, sealed = F.col("event_id") % 971 == 0, (F.col("event_id") % 977 == 0) & (F.col("event_id") % 971 != 0)
    forged = chain.withColumn("event_type", F.when(plain | sealed, "forged").otherwise(F.col("event_type")))
    forged = forged.withColumn("hash", F.when(sealed, F.sha2(F.concat(audit_payload(), "prev"), 256)).otherwise(F.col("hash")))
    return gv.breaks(forged, "user_id", ["event_id"], audit_payload()).select("user_id", "event_id", "why")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50)")
def audit_append(spark, d):
    """Events of a batch whose ids the log does not hold yet."""
    rows = events(spark, d)
    return gv.new_only(rows.filter("value > 50"), rows.filter("event_type = 'purchase'").select("event_id", "event_type"), "event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def erasure(spark, d):
    subjects = load(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("user_id"))
    return gv.erase(events(spark, d), subjects, "user_id").select("event_id", "user_id")


@query("""WITH l AS (SELECT user_id, string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', chr(10) ORDER BY event_id) AS payload FROM events GROUP BY user_id) SELECT user_id, payload, sha256(payload) AS checksum FROM l""")
def subject_export(spark, d):
    return gv.export(events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_id, user_id, ts FROM events WHERE NOT ts < TIMESTAMP '2024-01-10'")
def audit_purge(spark, d):
    """The log without events before the cut."""
    return delete_where(events(spark, d), F.col("ts") < "2024-01-10").select("event_id", "user_id", "ts")


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND list_contains(['view', 'purchase'], event_type) GROUP BY ALL")
def processing_log(spark, d):
    """A subject's processing records in an inclusive range, by purpose."""
    rows = events(spark, d).filter(F.col("ts").between("2024-01-05", "2024-01-20") & F.array_contains(F.array(F.lit("view"), F.lit("purchase")), F.col("event_type")))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
