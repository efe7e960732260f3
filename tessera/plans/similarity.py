"""Queries on one similarity join of vectors: near pairs, names by embedding, consolidated memories, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import entities as en
from tessera.operators import knowledge as kn
from tessera.operators import memory as m
from tessera.operators import similarity as s
from tessera.plans.registry import query
from tessera.plans.retrieval import COS
from tessera.sources.tables import load

#: The tables' vectors are nearly at right angles, so what counts as near here lies lower than in use (0.85 to 0.95).
NEAR = 0.3
_PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS} >= {NEAR})"


def points(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("scope"))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def similar_vectors(spark, d):
    """All pairs of a label's vectors at a cosine or nearer, by cells of trained centres."""
    return s.near_pairs(points(spark, d), NEAR).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a) SELECT id, min(c) AS canonical FROM r GROUP BY id""")
def entities_by_embedding(spark, d):
    """Entity names that no rule of letters ties, resolved by their embeddings; the least id of a component is canonical."""
    names = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.md5(F.col("vec_id").cast("string").cast("binary")).alias("name"), "embedding")
    return en.same_entities(names, edits=2, cosine=NEAR)


@query(f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT b AS vec_id, list(a) AS near FROM pairs GROUP BY b),
n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, coalesce(near, []) AS near FROM embeddings LEFT JOIN b USING (vec_id)),
g AS (SELECT DISTINCT label, 0::BIGINT AS k, []::BIGINT[] AS kept FROM n UNION ALL SELECT n.label, n.k, CASE WHEN list_has_any(near, kept) THEN kept ELSE list_append(kept, vec_id) END FROM g JOIN n ON n.label = g.label AND n.k = g.k + 1),
u AS (SELECT unnest(arg_max(kept, k)) AS id FROM g GROUP BY label),
acc AS (SELECT user_id, count(*) AS c FROM events GROUP BY user_id),
sc AS (SELECT id, round(least(1, ln(coalesce(c, 0) + 1) / ln(101)), 6) AS relevance FROM u LEFT JOIN acc ON user_id = id),
rk AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS rank, count(*) OVER () AS n FROM sc)
SELECT id, relevance, rank FROM rk WHERE rank <= greatest(1, floor(n * 0.2))""")
def memory_consolidation(spark, d):
    """Memories without later near copies of kept ones, of which the fifth with most relevance goes on."""
    used = load(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("c"))
    relevance = F.round(F.least(F.lit(1.0), F.log(F.coalesce("c", F.lit(0)) + 1) / F.log(F.lit(101.0))), 6)
    rows = points(spark, d).join(used, "id", "left").select("id", "embedding", "scope", relevance.alias("relevance"))
    return m.consolidated(rows, NEAR, 0.2).select("id", "relevance", "rank")


@query()
def type_clusters(spark, d):
    """Average-linkage clusters of each label's vectors; tests hold them against a plain dendrogram."""
    return s.average_linkage(points(spark, d), 0.25)


def _domains(k: int = 8, rounds: int = 3) -> str:
    """SQL: rounds of means and nearest means, component by component."""
    steps = ["p AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)",
             "n AS MATERIALIZED (SELECT id, sqrt(sum(x * x)) AS n FROM p GROUP BY id)",
             f"c0 AS MATERIALIZED (SELECT j, i, x AS m FROM p JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS j FROM n ORDER BY id LIMIT {k}) USING (id))"]
    for r in range(rounds + 1):
        steps.append(f"s{r} AS MATERIALIZED (SELECT id, j, round(sum(x * m) / (any_value(n.n) * any_value(z.z)), 6) AS score FROM p JOIN c{r} USING (i) JOIN n USING (id) JOIN (SELECT j, sqrt(sum(m * m)) AS z FROM c{r} GROUP BY j) z USING (j) GROUP BY id, j)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, j, score FROM s{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, j) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT j, i, avg(x) AS m FROM p JOIN a{r} USING (id) GROUP BY j, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.i, coalesce(m.m, c.m) AS m FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j AND m.i = c.i)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT id, j::INTEGER AS cluster, score FROM a{rounds}"


@query(_domains())
def spherical_domains(spark, d):
    """Domains of all vectors by cosine to mean vectors, three rounds from the eight least ids."""
    return kn.spherical(points(spark, d), 8).select("id", "cluster", "score")
