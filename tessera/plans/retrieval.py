"""Retrieval queries: benchmark passages ask, documents answer.

A document's vector is the one of its id. A passage has none, so the dense channel asks
with the vector of its best keyword answer that has one (pseudo-relevance feedback).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import retrieval as r
from tessera.operators import sparse
from tessera.plans.registry import query
from tessera.session import saved, shared_dir, small
from tessera.sources.tables import load

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOK = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '' AND w NOT IN (" + _STOP + "))"

#: Terms, document frequencies and BM25 scores as common table expressions.
BM25_SQL = f"""
toks AS (SELECT doc_id AS id, lang, {_TOK.format('text')} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks WHERE len(ts) > 0),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format('text')}) AS term FROM benchmark),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM asked JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY qid, id)
"""

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COS = f"round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6)"


def asked(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def dense(spark, d, words, k):
    """Queries: the vectors of each item's best keyword answer (of ``words``) that has one, against all vectors."""
    points = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    known = words.join(points.select("id"), "id", "left_semi").groupBy("qid").agg(F.min_by("id", "rank").alias("id"))
    queries = points.join(small(known), "id").select("qid", F.col("embedding").alias("q_embedding"))
    return r.knn_top(points, queries, k)


def every_fiftieth(spark, d):
    """The stated set of vector queries: every row whose id is divisible by 50."""
    points = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("scope"))
    return points, points.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q_embedding"), "scope")


@query(f"WITH {BM25_SQL}, rk AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm) SELECT * FROM rk WHERE rank <= 10")
def bm25_topk(spark, d):
    """Keyword search: ten best documents of every item, later ids first on ties."""
    return r.bm25_top(load(spark, d, "documents"), asked(spark, d), 10)


@query(f"WITH {BM25_SQL}, rk AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm) SELECT * FROM rk WHERE rank <= 10")
def bm25_index(spark, d):
    """The same search from an index that is written and read again."""
    path = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    r.write_index(load(spark, d, "documents"), path)
    return r.search_index(spark, path, asked(spark, d), 10)


@query(f"""SELECT qid, id, score, rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {COS} AS score,
    row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE rank <= 10""")
def knn_topk(spark, d):
    """Exact dense search: ten nearest vectors of every fiftieth one."""
    return r.knn_top(*every_fiftieth(spark, d), 10)


#: Dense scores of the vector of each query's best keyword answer among ``k`` (table bmr) that has one.
FEEDBACK = f"""seed AS (SELECT qid, arg_min(bmr.id, rank) AS id FROM bmr JOIN embeddings ON vec_id = bmr.id WHERE rank <= {{k}} GROUP BY qid),
dn AS (SELECT seed.qid AS qid, a.vec_id AS id, {COS} AS score FROM seed JOIN embeddings b ON b.vec_id = seed.id, embeddings a)"""

_HYBRID = f"""WITH {BM25_SQL},
bmr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm),
{FEEDBACK.format(k=40)},
dnr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dn),
un AS (SELECT qid, id, {{w0}} / (60 + rank) AS part FROM bmr WHERE rank <= 40 UNION ALL SELECT qid, id, {{w1}} / (60 + rank) FROM dnr WHERE rank <= 20),
fused AS (SELECT qid, id, round(sum(part), 9) AS score FROM un GROUP BY qid, id)
"""


def channels(spark, d):
    words = saved(r.bm25_top(load(spark, d, "documents"), asked(spark, d), 40))
    return [words, dense(spark, d, words, 20)]


@query(_HYBRID.format(w0="1.0::DOUBLE", w1="1.0::DOUBLE") + """
SELECT * FROM (SELECT f.qid, f.id, f.score, row_number() OVER (PARTITION BY f.qid ORDER BY f.score DESC, f.id) AS rank
FROM fused f JOIN documents d ON d.doc_id = f.id WHERE d.lang IN ('en', 'de')) WHERE rank <= 10""")
def hybrid_search(spark, d):
    """Keyword and dense channels, rank fusion, language filter, ten best: the flagship."""
    docs = load(spark, d, "documents").filter(F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("id"))
    return r.top(r.fuse(channels(spark, d)).join(docs, "id"), 10).select("qid", "id", "score", "rank")


@query(_HYBRID.format(w0="(0.6 / 0.7)::DOUBLE", w1="(0.1 / 0.7)::DOUBLE") + """
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10""")
def weighted_rrf(spark, d):
    """Fusion with the keyword profile's weights, normalised to one."""
    return r.top(r.fuse(channels(spark, d), weights=r.normalised([0.6, 0.1])), 10).select("qid", "id", "score", "rank")


@query(_HYBRID.format(w0="1.0::DOUBLE", w1="1.0::DOUBLE") + """,
ent AS (SELECT item_id AS qid, w AS entity, row_number() OVER (PARTITION BY item_id ORDER BY w) AS er FROM
  (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 9)) AS w FROM benchmark)),
men AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 9)) AS entity FROM documents),
boost AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + er)) AS b FROM ent JOIN men USING (entity) GROUP BY qid, id)
SELECT * FROM (SELECT qid, id, round(score + 0.3::DOUBLE * coalesce(b, 0), 9) AS final_score,
  row_number() OVER (PARTITION BY qid ORDER BY round(score + 0.3::DOUBLE * coalesce(b, 0), 9) DESC, id) AS rank FROM fused LEFT JOIN boost USING (qid, id)) WHERE rank <= 10""")
def cross_modal_boost(spark, d):
    """Fused chunks boosted by the query's entities (its long words) that they mention."""
    long = lambda c: F.array_distinct(F.filter(tx.words(c), lambda w: F.length(w) >= 9))
    entities = asked(spark, d).select("qid", F.explode(F.array_sort(long(F.col("text")))).alias("entity"))
    ranked = entities.withColumn("entity_rank", F.row_number().over(Window.partitionBy("qid").orderBy("entity")))
    mentions = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(long(F.col("text"))).alias("entity"))
    out = r.entity_boost(r.fuse(channels(spark, d)), ranked, mentions)
    return r.top(out, 10, by="final_score").select("qid", "id", "final_score", "rank")


_CHUNK_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 9))"


#: Graph channels: entities are long words, their communities share the first two letters.
ENTITY_SQL = f"""men AS (SELECT doc_id AS id, unnest({_CHUNK_WORDS}) AS entity FROM documents), named AS (SELECT item_id AS qid, unnest({_CHUNK_WORDS}) AS entity FROM benchmark),
local_ AS (SELECT qid, id, count(*) AS n_entities, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, id) AS rank FROM named JOIN men USING (entity) GROUP BY qid, id),
topic AS (SELECT qid, community FROM (SELECT qid, substr(entity, 1, 2) AS community, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, substr(entity, 1, 2)) AS k FROM named GROUP BY qid, substr(entity, 1, 2)) WHERE k <= 3),
inside AS (SELECT id, substr(entity, 1, 2) AS community, count(*) AS n FROM men GROUP BY ALL),
global_ AS (SELECT qid, id, sum(n)::BIGINT AS n_entities, row_number() OVER (PARTITION BY qid ORDER BY sum(n) DESC, id) AS rank FROM topic JOIN inside USING (community) GROUP BY qid, id)"""


def mentions_of(rows, id_):
    """(id, entity): the long words of each text, once."""
    long = F.array_distinct(F.filter(tx.words(F.col("text")), lambda w: F.length(w) >= 9))
    return rows.select(F.col(id_).alias("id"), F.explode(long).alias("entity"))


def _by_index(spark, postings, asks, k):
    """(qid, id, n_entities, rank) of the ``k`` rows (id, term, weight) with the greatest sums for each query (qid, term)."""
    index = sparse.write_index(postings, f"{shared_dir(spark)}/entities-{uuid.uuid4().hex}")
    found, _ = sparse.search(index, asks.select("qid", "term", F.lit(1.0).alias("weight")), k)
    return found.select("qid", "id", F.col("score").cast("long").alias("n_entities"), "rank")


def local_ranks(spark, d, k):
    """The local graph channel: chunks by the query's entities they mention, blocks of them that can't be among the ``k`` best unread."""
    men, named = mentions_of(load(spark, d, "documents"), "doc_id"), mentions_of(load(spark, d, "benchmark"), "item_id")
    return _by_index(spark, men.select("id", F.col("entity").alias("term"), F.lit(1.0).alias("weight")), named.select(F.col("id").alias("qid"), F.col("entity").alias("term")), k)


def global_ranks(spark, d, k):
    """The global graph channel: chunks by all entities of the query's three communities."""
    men, named = mentions_of(load(spark, d, "documents"), "doc_id"), mentions_of(load(spark, d, "benchmark"), "item_id").withColumnRenamed("id", "qid")
    community = F.substring("entity", 1, 2).alias("term")
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "term")
    topic = named.groupBy("qid", community).agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("qid", "term")
    return _by_index(spark, men.groupBy("id", community).agg(F.count("*").alias("weight")), topic, k)


@query(f"WITH {ENTITY_SQL} SELECT * FROM local_ WHERE rank <= 5")
def entity_chunks(spark, d):
    """Graph local: chunks that mention most of a query's entities."""
    return local_ranks(spark, d, 5)


@query(f"WITH {ENTITY_SQL} SELECT * FROM global_ WHERE rank <= 5")
def community_chunks(spark, d):
    """Graph global: chunks with most entities of the query's communities."""
    return global_ranks(spark, d, 5)


@query(f"""WITH {ENTITY_SQL}, top_ AS (SELECT qid, id, rank FROM local_ WHERE rank <= 10), seen AS (SELECT DISTINCT qid, entity FROM top_ JOIN men USING (id)),
o AS (SELECT qid, id, count(*) AS overlap FROM seen JOIN men USING (entity) WHERE NOT EXISTS (SELECT 1 FROM top_ WHERE top_.qid = seen.qid AND top_.id = men.id) GROUP BY qid, id)
SELECT qid, id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, id) AS k FROM o) WHERE k <= 10""")
def entity_expansion(spark, d):
    """Chunks that share most entities with the ten found first, without these."""
    men = mentions_of(load(spark, d, "documents"), "doc_id")
    return r.expand(local_ranks(spark, d, 10).select("qid", "id"), men, 10)


@query(f"""WITH c AS (SELECT label, [avg(x) FOR x IN []]::DOUBLE[] AS z FROM embeddings GROUP BY label),
el AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
nrm AS (SELECT label, sqrt(sum(m * m)) AS s FROM el GROUP BY label),
pts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
pn AS (SELECT vec_id, sqrt(sum(x * x)) AS s FROM pts GROUP BY vec_id),
sc AS (SELECT vec_id, el.label AS domain, round(sum(x * m) / (any_value(pn.s) * any_value(nrm.s)), 6) AS score FROM pts JOIN el USING (i) JOIN nrm USING (label) JOIN pn USING (vec_id) GROUP BY vec_id, el.label)
SELECT vec_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, domain) AS r FROM sc) WHERE r = 1""".replace("c AS (SELECT label, [avg(x) FOR x IN []]::DOUBLE[] AS z FROM embeddings GROUP BY label),\n", ""))
def domain_classify(spark, d):
    """Each vector's nearest domain, a domain being the mean vector of a label."""
    points = load(spark, d, "embeddings")
    means = points.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q_embedding"))
    scored = r.knn(points.select(F.col("vec_id").alias("id"), "embedding"), centres.withColumnRenamed("label", "qid"))
    best = r.top(scored.withColumnsRenamed({"qid": "domain", "id": "vec_id"}), 1, tie="domain", group="vec_id")
    return best.select("vec_id", "domain", "score")


@query(f"""SELECT qid, id, score FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS r
FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label) WHERE r = 1 AND score >= 0.3""")
def semantic_cache_probe(spark, d):
    """The nearest other entry of the same namespace (label), if near enough."""
    return r.knn_top(*every_fiftieth(spark, d), 1, scoped=True).filter("score >= 0.3").select("qid", "id", "score")


@query(_HYBRID.format(w0="1.0::DOUBLE", w1="1.0::DOUBLE") + """
SELECT qid, count(DISTINCT id) AS n_distinct, sum(CASE WHEN c = 2 THEN 1 ELSE 0 END)::BIGINT AS n_common, round(sum(CASE WHEN c = 2 THEN 1 ELSE 0 END) / 10.0::DOUBLE, 6) AS overlap
FROM (SELECT qid, id, count(*) AS c FROM (SELECT qid, id FROM bmr WHERE rank <= 10 UNION ALL SELECT qid, id FROM dnr WHERE rank <= 10) GROUP BY qid, id) GROUP BY qid""")
def ranking_diversity(spark, d):
    """How far the channels' ten best agree."""
    words, near = channels(spark, d)
    every = words.filter("rank <= 10").select("qid", "id").unionByName(near.filter("rank <= 10").select("qid", "id"))
    seen = every.groupBy("qid", "id").agg(F.count("*").alias("c"))
    common = F.count_if(F.col("c") == 2)
    return seen.groupBy("qid").agg(F.count("*").alias("n_distinct"), common.alias("n_common"), F.round(common / F.lit(10.0), 6).alias("overlap"))


@query("""WITH k AS (SELECT doc_id, source, lower(trim(left(text, 200), ' ')) AS key FROM documents)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM k WHERE key <> '') WHERE r = 1""")
def context_dedup(spark, d):
    """One context for each beginning of 200 characters."""
    return r.dedup_contexts(load(spark, d, "documents"), F.col("doc_id")).select("doc_id", "source")


@query("""WITH k AS (SELECT page_id AS seq, regexp_replace(url, '\\?.*$', '') AS u, lower(trim(left(html, 200), ' ')) AS t FROM pages),
f AS (SELECT seq, u, t, min(seq) OVER (PARTITION BY u) AS fu, min(seq) OVER (PARTITION BY t) AS ft FROM k)
SELECT seq, u AS url FROM f WHERE (u = '' OR fu = seq) AND (t = '' OR ft = seq)""")
def fusion_dedup(spark, d):
    """Web results without repeated addresses or beginnings."""
    pages = load(spark, d, "pages").select(F.col("page_id").alias("seq"), F.regexp_replace("url", r"\?.*$", "").alias("url"), F.col("html").alias("text"))
    return r.dedup_fused(pages).select("seq", "url")


@query("""SELECT doc_id, source, used FROM (SELECT doc_id, source, (sum(length(text) // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= 20000""")
def context_budget(spark, d):
    """A source's longest contexts while they fit a budget of tokens (characters / 4)."""
    cost = F.floor(F.length("text") / 4).cast("long")
    rows = r.within_budget(load(spark, d, "documents"), 20000, "source", F.desc("n_chars"), F.col("doc_id"), cost=cost)
    return rows.select("doc_id", "source", "used")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT round(1 / (1 + sum((n - total / k::DOUBLE) * (n - total / k::DOUBLE) / (total / k::DOUBLE)) / any_value(total)), 6) AS diversity FROM c, t""")
def source_diversity(spark, d):
    """How evenly results come from their sources: 1 / (1 + chi-squared / n)."""
    counts = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("q"))
    chi = F.col("q") * F.col("k") / F.col("t") - F.col("t")
    return sums.select(F.round(1 / (1 + chi / F.col("t")), 6).alias("diversity"))


@query("""SELECT lang, n, avg_score, CASE WHEN avg_score >= 1500 AND n >= 100 THEN 'excellent' WHEN avg_score >= 1000 THEN 'good' WHEN n > 0 THEN 'fair' ELSE 'poor' END AS grade
FROM (SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS avg_score FROM documents GROUP BY lang)""")
def search_quality(spark, d):
    """A grade of each group of contexts by count and mean score."""
    rows = load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_score"))
    grade = F.when((F.col("avg_score") >= 1500) & (F.col("n") >= 100), "excellent").when(F.col("avg_score") >= 1000, "good").when(F.col("n") > 0, "fair").otherwise("poor")
    return rows.withColumn("grade", grade)
