"""Quality queries: parts are entities, order lines relations, piped lines of documents tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import quality as ql
from tessera.plans.registry import query
from tessera.sources.tables import events, load


@query("""SELECT p_partkey, CASE WHEN p_type IN ('CARDINAL', 'ORDINAL', 'PERCENT', 'QUANTITY') THEN 'noise_type' WHEN length(regexp_replace(p_name, '(?i)^(the |a |an )', '')) < 2 THEN 'too_short' WHEN length(p_name) > 80 THEN 'too_long' WHEN lower(p_name) IN ('small ring', 'red widget') THEN 'stop_name' END AS reason FROM part""")
def entity_filter(spark, d):
    reason = ql.entity_reason(F.col("p_name"), F.col("p_type"), ("small ring", "red widget"))
    return load(spark, d, "part").select("p_partkey", reason.alias("reason"))


_REL = "rel AS (SELECT 'S' || l_suppkey % 10 AS source, 's' || l_partkey % 10 AS target, CASE l_returnflag WHEN 'A' THEN 'RELATED_TO' WHEN 'N' THEN 'SUPPLIES' ELSE 'MADE_OF' END AS type, l_linestatus AS description, l_quantity AS weight, CASE WHEN l_linenumber = 1 THEN '' ELSE 'line' END AS evidence FROM lineitem)"


def relations(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "RELATED_TO").when(F.col("l_returnflag") == "N", "SUPPLIES").otherwise("MADE_OF")
    name = lambda prefix, c: F.concat(F.lit(prefix), (F.col(c) % 10).cast("string"))
    return load(spark, d, "lineitem").select(
        name("S", "l_suppkey").alias("source"), name("s", "l_partkey").alias("target"), kind.alias("type"), F.col("l_linestatus").alias("description"),
        F.col("l_quantity").alias("weight"), F.when(F.col("l_linenumber") == 1, "").otherwise("line").alias("evidence"),
    )


@query(f"""WITH {_REL}, k AS (SELECT CASE WHEN type = 'RELATED_TO' THEN least(lower(source), lower(target)) ELSE lower(source) END AS a, CASE WHEN type = 'RELATED_TO' THEN greatest(lower(source), lower(target)) ELSE lower(target) END AS b, type, description, weight FROM rel)
SELECT a, b, type, max(weight) AS weight, count(*) AS n, string_agg(DISTINCT description, '; ' ORDER BY description) AS descriptions FROM k GROUP BY ALL""")
def relation_dedup(spark, d):
    return ql.dedup_relations(relations(spark, d))


@query(f"""WITH {_REL}, c AS (SELECT count(*) AS n, count(*) FILTER (lower(source) = lower(target)) AS loops, count(*) FILTER (evidence = '') AS no_evidence, count(*) FILTER (type NOT IN ('SUPPLIES', 'RELATED_TO')) AS bad_type FROM rel)
SELECT *, round(100 * (1 - (loops + no_evidence + bad_type) / n::DOUBLE), 4) AS score FROM c""")
def kg_hygiene(spark, d):
    return ql.hygiene(relations(spark, d), ("SUPPLIES", "RELATED_TO"))


@query(f"WITH {_REL} SELECT type, count(*) AS n, round(avg(weight), 6) AS mean FROM (SELECT CASE translate(upper(trim(type)), ' -', '__') WHEN 'MADE_OF' THEN 'PART_OF' ELSE translate(upper(trim(type)), ' -', '__') END AS type, weight FROM rel) GROUP BY type")
def relation_type_normalise(spark, d):
    rows = relations(spark, d).withColumn("type", tx.relation_type(F.col("type"), {"MADE_OF": "PART_OF"}))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean"))


@query("""WITH p AS (SELECT count(*) AS n FROM part), o AS (SELECT count(*) AS orphans FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)), m AS (SELECT count(*) AS ms FROM orders WHERE o_orderstatus = 'P')
SELECT n, orphans, ms AS no_source, round(greatest(0.0, 1 - (orphans + 0.5 * ms) / (n + 10000)::DOUBLE), 3) AS score FROM p, o, m""")
def consistency_score(spark, d):
    lines = load(spark, d, "lineitem").filter("l_quantity > 45")
    parts = load(spark, d, "part")
    orphans = parts.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_anti").agg(F.count("*").alias("orphans"))
    missing = load(spark, d, "orders").filter("o_orderstatus = 'P'").agg(F.count("*").alias("no_source"))
    rows = parts.agg(F.count("*").alias("n")).crossJoin(orphans).crossJoin(missing)  # one row each
    return rows.withColumn("score", F.round(ql.consistency(F.col("n") + 10000, F.col("orphans"), F.lit(0), F.col("no_source")), 3))


_CELLS = """lines AS (SELECT doc_id, ls, t FROM (SELECT doc_id, generate_subscripts(ls, 1) AS ls, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE contains(t, ' | '))"""
_NUM = "regexp_matches(regexp_replace(c, '[,\\s$%]', '', 'g'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')"


@query(f"""WITH {_CELLS}, w AS (SELECT doc_id, ls, row_number() OVER (PARTITION BY doc_id ORDER BY ls) AS r, string_split(t, ' | ') AS row_ FROM lines),
c AS (SELECT doc_id, r, len(row_) AS width, unnest(row_) AS c FROM w)
SELECT doc_id, round(count(*) FILTER (trim(c, ' ') <> '') / count(*)::DOUBLE, 6) AS density, round(1 / count(DISTINCT width)::DOUBLE, 6) AS rectangular,
round(0.6 * count(*) FILTER (r = 1 AND NOT {_NUM}) / count(*) FILTER (r = 1)::DOUBLE + CASE WHEN count(*) FILTER (r > 1) > 0 THEN 0.4 * count(*) FILTER (r > 1 AND {_NUM}) / count(*) FILTER (r > 1)::DOUBLE ELSE 0.0 END, 6) AS header FROM c GROUP BY doc_id""")
def table_quality(spark, d):
    """Density, rectangularity and header plausibility of each document's table."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter(F.col("t").contains(" | "))
    rows = F.array_sort(F.collect_list(F.struct("line", F.split("t", r" \| ").alias("row"))))
    tables = lines.groupBy("doc_id").agg(F.transform(rows, lambda x: x["row"]).alias("cells"))
    return tables.select("doc_id", *[F.round(c, 6).alias(name) for name, c in ql.table_quality(F.col("cells")).items()])


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'ingest' WHEN value / 100 >= 0.5 THEN 'with_warning' ELSE 'rejected' END AS gate, value / 100 BETWEEN 0.5 AND 0.85 AS cross_validate FROM events""")
def table_gate(spark, d):
    score = F.col("value") / 100
    return events(spark, d).select("event_id", ql.grade(score).alias("gate"), score.between(0.5, 0.85).alias("cross_validate"))


@query("""WITH e AS (SELECT event_type AS model, lower(trim('User ' || user_id % 40)) AS name, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS prio, event_id FROM events)
SELECT name, model, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio, event_id) AS r FROM e) WHERE r = 1""")
def multi_model_merge(spark, d):
    """Entities of several models: the first model that has a name wins."""
    prio = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    rows = events(spark, d).select(F.col("event_type").alias("model"), F.lower(F.trim(F.concat(F.lit("User "), (F.col("user_id") % 40).cast("string")))).alias("name"), prio.alias("prio"), "event_id")
    w = Window.partitionBy("name").orderBy("prio", "event_id")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", "model", "event_id")


@query("""WITH a AS (SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')), seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value >= 20)
SELECT e.user_id, min(e.event_id) AS first_event, 'llm' AS source FROM events e WHERE e.event_type = 'purchase' AND e.user_id NOT IN (SELECT user_id FROM seen) GROUP BY e.user_id UNION ALL SELECT user_id, event_id, 'ner' FROM events WHERE event_type = 'view' AND value >= 20""")
def consolidate_entities(spark, d):
    """The first extractor's sure rows stay whole; the second one's are added once where unseen."""
    rows = events(spark, d)
    ner = rows.filter((F.col("event_type") == "view") & (F.col("value") >= 20))
    llm = rows.filter("event_type = 'purchase'").join(ner.select("user_id").distinct(), "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return llm.withColumn("source", F.lit("llm")).unionByName(ner.select("user_id", F.col("event_id").alias("first_event"), F.lit("ner").alias("source")))


@query("""SELECT idx, sum(w)::DOUBLE AS w_sum, max(w)::DOUBLE AS w_max, round(avg(w), 6)::DOUBLE AS w_avg FROM (SELECT generate_subscripts(embedding, 1) - 1 AS idx, round(unnest(embedding)::DOUBLE * 100, 0) AS w FROM embeddings) WHERE w > 5 GROUP BY idx""")
def sparse_merge(spark, d):
    """Sparse vectors merged index by index: sum, maximum and mean of weights."""
    rows = load(spark, d, "embeddings").select(F.posexplode("embedding").alias("idx", "x")).select(F.col("idx").cast("long").alias("idx"), F.round(F.col("x").cast("double") * 100, 0).alias("w")).filter("w > 5")
    return rows.groupBy("idx").agg(F.sum("w").alias("w_sum"), F.max("w").alias("w_max"), F.round(F.avg("w"), 6).alias("w_avg"))
