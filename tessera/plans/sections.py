"""The section graph of the documents: a line is a section, its length gives its level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sectiongraph as s
from tessera.plans.registry import query
from tessera.plans.similarity import NEAR, _PAIRS
from tessera.sources.tables import load

_LINES = "s AS MATERIALIZED (SELECT doc_id AS doc, p - 1 AS seq, doc_id * 100000 + p - 1 AS id, CASE WHEN p = 1 THEN 1 WHEN length(t) < 300 THEN 2 WHEN length(t) < 800 THEN 3 ELSE 4 END AS level, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def sections(spark, d):
    lines = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    level = F.when(F.col("seq") == 0, 1).when(F.length("text") < 300, 2).when(F.length("text") < 800, 3).otherwise(4)
    return lines.select("doc", "seq", (F.col("doc") * 100000 + F.col("seq")).alias("id"), level.alias("level"), F.col("text").alias("heading"), "text")


@query(f"""WITH {_LINES} SELECT p.id AS src, c.id AS dst, 'PARENT_OF' AS kind, 1.0::DOUBLE AS weight FROM (SELECT c.id, max(p.seq) AS up, any_value(c.doc) AS doc FROM s c JOIN s p ON p.doc = c.doc AND p.seq < c.seq AND p.level < c.level GROUP BY c.id) c JOIN s p ON p.doc = c.doc AND p.seq = c.up
UNION ALL SELECT a.id, b.id, 'FOLLOWS', 0.5 FROM s a JOIN s b ON b.doc = a.doc AND b.seq = a.seq + 1""")
def section_hierarchy(spark, d):
    """Parents by level and the next section of every line."""
    rows = sections(spark, d)
    return s.parents(rows).unionByName(s.follows(rows))


@query(f"""WITH {_LINES}, w AS (SELECT doc, id, {_WORDS} AS w FROM s), b AS (SELECT DISTINCT doc, id, w[k] || ' ' || w[k + 1] AS phrase FROM (SELECT doc, id, w, unnest(range(1, len(w))) AS k FROM w)),
h AS (SELECT doc, id, w[1] || ' ' || w[2] AS phrase FROM w WHERE len(w) >= 2)
SELECT DISTINCT b.id AS src, h.id AS dst, 'REFERENCES' AS kind, 0.8::DOUBLE AS weight FROM b JOIN h USING (doc, phrase) WHERE b.id <> h.id AND length(phrase) >= 8""")
def section_references(spark, d):
    """Lines that name another line of their document by its first two words."""
    return s.references(sections(spark, d))


@query(f"WITH {_PAIRS} SELECT a * 100000 AS src, b * 100000 AS dst, 'SIMILAR_TO' AS kind, score AS weight FROM pairs")
def section_similarity(spark, d):
    """First lines with their documents' vectors."""
    points = load(spark, d, "embeddings").select((F.col("vec_id") * 100000).alias("id"), "embedding", F.col("label").alias("scope"))
    return s.similar(points, NEAR)
