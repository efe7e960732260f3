"""Coreference over the documents, in their own languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import coreference as c
from tessera.plans.registry import query
from tessera.sources.tables import load

_KNOWN = """CASE lang WHEN 'de' THEN ['er', 'sie', 'ihm', 'ihr', 'sein', 'seine', 'ihrer', 'dessen', 'deren', 'es']
WHEN 'fr' THEN ['il', 'elle', 'lui', 'leur', 'eux', 'elles', 'son', 'sa', 'ses', 'leurs', 'ce', 'ça', 'cela', 'ceci', 'qui', 'que', 'dont', 'lequel', 'laquelle', 'lesquels', 'lesquelles']
WHEN 'es' THEN ['él', 'ella', 'ellos', 'ellas', 'le', 'les', 'lo', 'la', 'los', 'las', 'su', 'sus', 'suyo', 'suya', 'ello', 'esto', 'eso', 'aquello', 'que', 'quien', 'quienes', 'cual', 'cuales', 'cuyo', 'cuya']
ELSE ['he', 'she', 'him', 'her', 'his', 'hers', 'himself', 'herself', 'they', 'them', 'their', 'theirs', 'themselves', 'it', 'its', 'itself', 'who', 'whom', 'whose', 'which', 'that'] END"""
_FOUND = f"""t AS (SELECT doc_id AS id, lang, regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+') AS runs FROM documents),
x AS (SELECT id, lang, unnest(runs) AS run, unnest(range(len(runs))) AS k FROM t),
r AS (SELECT *, coalesce(sum(length(run)) OVER w, 0)::BIGINT AS start, coalesce(sum(regexp_matches(run, '[.!?]')::INT) OVER w, 0)::BIGINT AS sentence FROM x WINDOW w AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT * FROM r WHERE list_contains({_KNOWN}, lower(run))), e AS (SELECT * FROM r WHERE regexp_full_match(run, '\\p{{Lu}}\\p{{Ll}}+') AND length(run) >= 6),
m AS (SELECT p.id, p.k, p.start, p.run AS pronoun, e.run AS antecedent, e.start AS place, CASE WHEN lower(p.run) IN ('it', 'its', 'itself') THEN 0 ELSE 10 END + (3 - (p.sentence - e.sentence)) * 2 + CASE WHEN p.sentence = e.sentence THEN 5 ELSE 0 END AS score
FROM p JOIN e ON e.id = p.id AND e.sentence BETWEEN p.sentence - 3 AND p.sentence AND e.start + length(e.run) < p.start),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY score DESC, place) = 1)"""


def _found(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    runs = c.runs_of(texts)
    return runs, c.antecedents(runs, c.capitalised(runs))


@query(f"WITH {_FOUND} SELECT id AS doc_id, antecedent, count(*) AS n, min(start) AS first, max(score) AS score FROM f GROUP BY ALL")
def coreference_chains(spark, d):
    """The capitalised words that pronouns of a document stand for, in its language."""
    rows = _found(spark, d)[1]
    return rows.groupBy(F.col("id").alias("doc_id"), "antecedent").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("score").alias("score"))


@query(f"WITH {_FOUND} SELECT id AS doc_id, sha256(string_agg(coalesce(antecedent, run), '' ORDER BY r.k)) AS text_sha256, count(antecedent) AS n_resolved FROM r LEFT JOIN (SELECT id, k, antecedent FROM f) USING (id, k) GROUP BY id")
def coreference_rewrite(spark, d):
    """Documents with their pronouns replaced."""
    rows = c.rewritten(*_found(spark, d))
    return rows.select(F.col("id").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_resolved")
