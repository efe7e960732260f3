"""Extraction by table functions over the documents, and canonical records of what is resolved."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import extraction as x
from tessera.operators import entities as en
from tessera.plans.registry import query
from tessera.sources.tables import load

_LONG = re.compile(r"[A-Za-z]{10,}")


def long_words(text):
    """A second extractor: ASCII words of ten letters or more."""
    return [("entity", m.group(), None, m.start()) for m in _LONG.finditer(text)]


def _docs(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


_SENT = "SELECT doc_id AS id, unnest(regexp_extract_all(text, '[^.!?\\n]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+'), 1) AS p FROM documents"
_NAMES = f"SELECT id, p, unnest(regexp_extract_all(s, '[A-Z][a-z]{{3,}}')) AS name, generate_subscripts(regexp_extract_all(s, '[A-Z][a-z]{{3,}}'), 1) AS k FROM ({_SENT})"


@query(f"SELECT id, name, count(*) AS n FROM ({_NAMES}) GROUP BY ALL")
def extracted_entities(spark, d):
    """Capitalised words of every document by a table function that is joined laterally."""
    rows = x.extracted(spark, _docs(spark, d), {"rules": x.capitalised_words}, "entity")
    return rows.groupBy("id", "name").agg(F.count("*").alias("n"))


@query(f"WITH n AS ({_NAMES}), l AS (SELECT id, lag(name) OVER (PARTITION BY id, p ORDER BY k) AS name, name AS target FROM n) SELECT id, name, target, count(*) AS n FROM l WHERE name IS NOT NULL AND name <> target GROUP BY ALL")
def extracted_relations(spark, d):
    """Neighbouring names of a sentence."""
    rows = x.extracted(spark, _docs(spark, d), {"rules": x.capitalised_words}, "relation")
    return rows.groupBy("id", "name", "target").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT id, lower(name) AS key, 'rules' AS model FROM ({_NAMES}) UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{10,}}'))), 'long' FROM documents)
SELECT id, key, count(DISTINCT model) AS n_models, count(*) AS n FROM m GROUP BY ALL HAVING count(DISTINCT model) >= 2""")
def entities_of_two_models(spark, d):
    """Entities that two extractors agree on, each run on every text side by side."""
    rows = x.extracted(spark, _docs(spark, d), {"rules": x.capitalised_words, "long": long_words})
    return x.merged_models(rows, 2).select("id", F.lower("name").alias("key"), "n_models", "n")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS place, p_brand AS c, p_name AS form, p_type AS description, p_size AS chunk, round(p_retailprice / 2500, 6)::DOUBLE AS confidence, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM part),
f AS (SELECT *, (place = min(place) OVER (PARTITION BY c, form))::INT AS fresh FROM e), k AS (SELECT *, sum(fresh) OVER (PARTITION BY c ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f),
g AS (SELECT c, t, confidence AS conf FROM k WHERE t = 1 UNION ALL SELECT k.c, k.t, CASE WHEN k.k > 1 THEN (g.conf * (k.k - 1) + k.confidence) / k.k ELSE k.confidence END FROM g JOIN k ON k.c = g.c AND k.t = g.t + 1)
SELECT e.c AS canonical, any_value(p.form) AS primary_name, count(DISTINCT e.form) AS n_forms, count(DISTINCT description) AS n_descriptions, count(DISTINCT chunk) AS n_chunks, count(*) AS n, min(place) AS first, round(any_value(l.conf), 6) AS confidence
FROM e JOIN (SELECT c, arg_min(form, t) AS form FROM e GROUP BY c) p ON p.c = e.c JOIN (SELECT c, arg_max(conf, t) AS conf FROM g GROUP BY c) l ON l.c = e.c GROUP BY e.c""")
def canonical_records(spark, d):
    """One record for each brand's part names: first form, forms, descriptions, chunks, and the confidence as it runs."""
    rows = load(spark, d, "part").select(
        F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("place"), F.col("p_name").alias("form"), F.col("p_type").alias("description"),
        F.col("p_size").alias("chunk"), F.round(F.col("p_retailprice") / 2500, 6).cast("double").alias("confidence"),
    )
    return en.canonical_records(rows).withColumn("confidence", F.round("confidence", 6))
