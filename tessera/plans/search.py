"""Searches composed of others: sub-queries, layers, skills, memories, archives, decisions on their results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import retrieval as r
from tessera.plans.registry import query
from tessera.plans.retrieval import BM25_SQL, COS, ENTITY_SQL, asked, every_fiftieth, global_ranks, local_ranks, mentions_of
from tessera.session import saved
from tessera.sources.tables import events, load

#: A query's parts: its first two sentences.
_PARTS = "(SELECT item_id, k, item_id * 2 + k AS qid, string_split(text, '. ')[k + 1] AS text FROM benchmark, (SELECT unnest([0, 1]) AS k))"
_SUB = BM25_SQL.replace("FROM benchmark)", f"FROM (SELECT qid AS item_id, text FROM {_PARTS} WHERE text <> ''))")
_SUB_RANKED = "sub AS (SELECT qid // 2 AS item, qid % 2 AS k, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm)"


def parts_of(spark, d):
    """(item_id, qid, text): the sub-queries of every benchmark item."""
    rows = load(spark, d, "benchmark").select("item_id", F.posexplode(F.slice(F.split("text", r"\. "), 1, 2)).alias("k", "text"))
    return rows.filter("text <> ''").select("item_id", (F.col("item_id") * 2 + F.col("k")).alias("qid"), "text")


def sub_results(spark, d, k):
    found = r.bm25_top(load(spark, d, "documents"), parts_of(spark, d).select("qid", "text"), k)
    return found.select(F.floor(F.col("qid") / 2).alias("item"), (F.col("qid") % 2).alias("k"), "id", "score", "rank")


@query(f"WITH {_SUB}, {_SUB_RANKED} SELECT * FROM (SELECT item AS qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, row_number() OVER (PARTITION BY item ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, id) AS rank FROM sub WHERE rank <= 20 GROUP BY item, id) WHERE rank <= 5")
def decomposed_search(spark, d):
    """Sub-queries searched each, their rankings fused by reciprocal ranks."""
    found = sub_results(spark, d, 20).withColumnRenamed("item", "qid")
    return r.top(r.fuse([found.filter("k = 0"), found.filter("k = 1")]), 5)


@query(f"""WITH {_SUB}, {_SUB_RANKED}, n AS (SELECT item, k, count(*) AS n FROM sub WHERE rank <= 5 AND score > 3 GROUP BY item, k), best AS (SELECT item, k FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, k) AS r FROM n) WHERE r = 1)
SELECT item AS qid, count(*) AS concatenated, sum(CASE WHEN best.k = sub.k THEN 1 ELSE 0 END)::BIGINT AS best FROM sub JOIN best USING (item) WHERE rank <= 5 AND score > 3 GROUP BY item""")
def merge_strategies(spark, d):
    """Sizes of the results put together, and of the fullest sub-result (the first of equals)."""
    found = sub_results(spark, d, 5).filter("score > 3")
    return r.merged_sizes(found, "item", "k").select(F.col("item").alias("qid"), "concatenated", "best")


@query(f"""WITH {_SUB}, {_SUB_RANKED}, t AS (SELECT * FROM sub WHERE rank <= 5 AND score > 3), n AS (SELECT item, k, count(*) AS n FROM t GROUP BY item, k), f AS (SELECT item, arg_max(k, (n, -k)) AS k FROM n GROUP BY item),
rr AS (SELECT item, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM t GROUP BY item, id)
SELECT 'concat' AS strategy, item AS qid, row_number() OVER (PARTITION BY item ORDER BY k, rank, id) AS place, id FROM t
UNION ALL SELECT 'best', item, row_number() OVER (PARTITION BY item ORDER BY rank, id), id FROM t JOIN f USING (item, k)
UNION ALL SELECT 'rrf', item, row_number() OVER (PARTITION BY item ORDER BY s DESC, id), id FROM rr""")
def merged_results(spark, d):
    """The sub-queries' results merged in three ways, as rows in order."""
    found = sub_results(spark, d, 5).filter("score > 3").withColumnRenamed("item", "qid")
    return r.merged_rows(found, "qid", "k")


_KIND = "CASE WHEN contains(lower(text), ' that ') THEN 'multi_hop' WHEN contains(lower(text), ' and ') THEN 'compound' ELSE 'simple' END"


@query(f"""SELECT conv_id, turn, kind, CASE WHEN kind = 'simple' OR confidence < 0.7 THEN 'direct' WHEN kind = 'compound' THEN 'parallel' ELSE 'sequential' END AS strategy FROM (SELECT conv_id, turn, {_KIND} AS kind, (turn % 10) / 10.0::DOUBLE AS confidence FROM conversations)""")
def decomposition_strategy(spark, d):
    """How a query's parts are run, by its kind where that is sure enough."""
    low = F.lower("text")
    kind = F.when(low.contains(" that "), "multi_hop").when(low.contains(" and "), "compound").otherwise("simple")
    rows = load(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), (F.col("turn") % 10 / 10.0).alias("c"))
    how = F.when((F.col("kind") == "simple") | (F.col("c") < 0.7), "direct").when(F.col("kind") == "compound", "parallel").otherwise("sequential")
    return rows.select("conv_id", "turn", "kind", how.alias("strategy"))


@query("""SELECT event_id, least(1.0, greatest(0.0, coalesce(CASE WHEN event_id % 5 = 0 THEN value / 40 - 0.2 END, CASE WHEN event_id % 3 = 0 THEN value / 50 END, CASE WHEN event_id % 2 = 0 THEN 0.016 END, 0.0)))::DOUBLE AS score, coalesce(CASE WHEN event_id % 5 = 0 THEN 1 END, CASE WHEN event_id % 3 = 0 THEN 2 END, 0) AS rank FROM events""")
def result_conversion(spark, d):
    """One score of many: normalised rerank, rerank, fusion, plain; clamped; ranks likewise."""
    k = F.col("event_id")
    rows = events(spark, d).select("event_id", F.when(k % 5 == 0, F.col("value") / 40 - 0.2).alias("n"), F.when(k % 3 == 0, F.col("value") / 50).alias("r"), F.when(k % 2 == 0, 0.016).alias("f"), F.when(k % 5 == 0, 1).alias("a"), F.when(k % 3 == 0, 2).alias("b"))
    return rows.select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("n", "r", "f", F.lit(0.0)))).alias("score"), F.coalesce("a", "b", F.lit(0)).alias("rank"))


_CENTRES = f"""el AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
nrm AS (SELECT label, sqrt(sum(m * m)) AS s FROM el GROUP BY label), pts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), pn AS (SELECT vec_id, sqrt(sum(x * x)) AS s FROM pts GROUP BY vec_id),
sc AS (SELECT vec_id, el.label AS skill, round(sum(x * m) / (any_value(pn.s) * any_value(nrm.s)), 6) AS score FROM pts JOIN el USING (i) JOIN nrm USING (label) JOIN pn USING (vec_id) GROUP BY vec_id, el.label)"""


def skill_scores(spark, d):
    """(skill, vec_id, score): contexts against skills' roles, a role being the mean vector of a label."""
    points = load(spark, d, "embeddings")
    means = points.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    roles = means.groupBy(F.col("label").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q_embedding"))
    return r.knn(points.select(F.col("vec_id").alias("id"), "embedding"), roles).withColumnsRenamed({"qid": "skill", "id": "vec_id"})


@query(f"WITH {_CENTRES} SELECT vec_id, skill, score FROM sc")
def context_scores(spark, d):
    """Every context scored for every skill."""
    return skill_scores(spark, d)


@query(f"""WITH {_CENTRES}, b AS (SELECT skill, vec_id, score, sum(20 + vec_id % 7) OVER (PARTITION BY skill ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM sc WHERE score >= 0.1) SELECT * FROM b WHERE used <= 500""")
def skill_routing(spark, d):
    """Each skill's best contexts while they fit its budget."""
    rows = skill_scores(spark, d).filter("score >= 0.1")
    return r.within_budget(rows, 500, "skill", F.desc("score"), F.col("vec_id"), cost=20 + F.col("vec_id") % 7).select("skill", "vec_id", "score", "used")


@query(f"""WITH q AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE + z[2]::DOUBLE) / 2) AS embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0)
SELECT qid, id, score, rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS rank FROM embeddings a, q b) WHERE rank <= 5""")
def hyde_search(spark, d):
    """Search by the mean of a query's vector and of its hypothetical document's (a column; here the next vector)."""
    points, asks = every_fiftieth(spark, d)
    made = load(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("qid"), F.col("embedding").alias("made"))
    mean = F.zip_with("q_embedding", "made", lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    return r.knn_top(points.select("id", "embedding"), asks.join(made, "qid").select("qid", mean.alias("q_embedding")), 5)


@query(f"""SELECT qid, id, score, rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS rank
FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label AND a.vec_id % 30 BETWEEN 3 AND 20 AND {COS} >= 0.1) WHERE rank <= 5""")
def archive_search(spark, d):
    """A user's archived conversations of a range of days that are near enough."""
    points, asks = every_fiftieth(spark, d)
    ranged = points.filter((F.col("id") % 30).between(3, 20))
    return r.knn_top(ranged, asks, 5, scoped=True).filter("score >= 0.1")  # the best five first, then the threshold


@query(f"""SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {COS} AS score FROM embeddings a JOIN events ON event_id = a.vec_id, embeddings b
WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label AND ts >= TIMESTAMP '2024-01-01 12:00:00')) WHERE r <= 10 AND score >= 0.1""")
def episodic_search(spark, d):
    """Each query's ten best episodes that are no older than a window, of those that score enough."""
    points, asks = every_fiftieth(spark, d)
    recent = events(spark, d).filter(F.col("ts") >= "2024-01-01 12:00:00").select(F.col("event_id").alias("id"))
    return r.knn_top(points.join(recent, "id", "left_semi"), asks, 10, scoped=True).filter("score >= 0.1").select("qid", "id", "score")


@query(f"""SELECT b.vec_id AS qid, max({COS}) >= 0.85 AS is_duplicate FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label GROUP BY b.vec_id""")
def semantic_duplicates(spark, d):
    """Whether a new entity is near to one that exists."""
    best = r.knn_top(*every_fiftieth(spark, d), 1, scoped=True)
    return best.select("qid", (F.col("score") >= 0.85).alias("is_duplicate"))


@query(f"""WITH {BM25_SQL}, {ENTITY_SQL}, w AS (SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm) WHERE rank <= 3),
v AS (SELECT qid, id, rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE rank <= 3)
SELECT 'keyword' AS layer, * FROM w UNION ALL SELECT 'vector', * FROM v UNION ALL SELECT 'graph', qid, id, rank FROM local_ WHERE rank <= 3""")
def unified_search(spark, d):
    """The best of every layer with the layer's name."""
    parts = {"keyword": r.bm25_top(load(spark, d, "documents"), asked(spark, d), 3), "vector": r.knn_top(*[x.drop("scope") for x in every_fiftieth(spark, d)], 3), "graph": local_ranks(spark, d, 3)}
    return r.all_of([rows.select(F.lit(name).alias("layer"), "qid", "id", "rank") for name, rows in parts.items()])


@query(f"""WITH {ENTITY_SQL}, near AS (SELECT qid, id, rank FROM local_ JOIN embeddings ON vec_id = id WHERE rank <= 20), seed AS (SELECT qid, arg_min(id, rank) AS id FROM near GROUP BY qid),
s AS (SELECT near.qid AS qid, near.id AS id, {COS} AS score FROM near JOIN seed ON seed.qid = near.qid JOIN embeddings a ON a.vec_id = near.id JOIN embeddings b ON b.vec_id = seed.id)
SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM s) WHERE k <= 5""")
def expand_rerank(spark, d):
    """Chunks found by their entities, ranked again by cosine to the first of them that has a vector."""
    vecs = load(spark, d, "embeddings").select("vec_id", "embedding")
    near = saved(local_ranks(spark, d, 20).join(vecs.withColumnsRenamed({"vec_id": "id", "embedding": "a"}), "id"))
    asks = near.groupBy("qid").agg(F.min_by("a", "rank").alias("b"))
    both = near.join(asks, "qid")
    scored = both.select("qid", "id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("score"))
    return r.top(scored, 5).select("qid", "id", "score")


@query(f"""WITH {ENTITY_SQL} SELECT qid, list(id ORDER BY place)::VARCHAR AS ids, count(*) AS n
FROM (SELECT qid, id, min(place) AS place FROM (SELECT qid, id, rank AS place FROM local_ WHERE rank <= 3 UNION ALL SELECT qid, id, 10 + rank FROM global_ WHERE rank <= 3) GROUP BY qid, id) GROUP BY qid""")
def dual_level_search(spark, d):
    """Local results, then unseen global ones, as one list for each query."""
    local, overall = local_ranks(spark, d, 3), global_ranks(spark, d, 3)
    listed = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    a = local.groupBy("qid").agg(listed(local).alias("a"))
    b = overall.groupBy("qid").agg(listed(overall).alias("b"))
    none = F.array().cast("array<bigint>")
    every = F.array_union(F.coalesce("a", none), F.coalesce("b", none))  # keeps the order: local first
    rows = a.join(b, "qid", "full_outer").select("qid", every.alias("ids"))
    return rows.select("qid", F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("]")).alias("ids"), F.size("ids").cast("long").alias("n"))


@query("""WITH t AS (SELECT item_id, lower(array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' ')) AS term FROM benchmark) SELECT item_id, count(*) AS n, count(DISTINCT source) AS communities FROM t JOIN documents ON contains(lower(text), term) GROUP BY item_id""")
def community_search(spark, d):
    """Chunks that hold a query's first three words as they stand, and the communities (sources) they come from."""
    terms = load(spark, d, "benchmark").select("item_id", F.lower(F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ")).alias("term"))
    docs = load(spark, d, "documents").select("source", "text")
    return r.holding(docs, terms, "text", "term").groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("source").alias("communities"))


@query("SELECT p_partkey, len(list_filter(['bolt', 'gear', 'red'], lambda t: contains(lower(p_name), t) OR contains(lower(p_type), t)))::BIGINT AS n_terms FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gear') OR contains(lower(p_name), 'red') OR contains(lower(p_type), 'bolt') OR contains(lower(p_type), 'gear') OR contains(lower(p_type), 'red')")
def substring_search(spark, d):
    """Entities of which name or description holds a query term."""
    terms = F.array(*[F.lit(t) for t in ("bolt", "gear", "red")])
    hit = F.filter(terms, lambda t: F.lower("p_name").contains(t) | F.lower("p_type").contains(t))
    return load(spark, d, "part").select("p_partkey", F.size(hit).cast("long").alias("n_terms")).filter("n_terms > 0")


@query(f"""WITH {ENTITY_SQL} SELECT entity, count(DISTINCT id) AS n_chunks, min(id) AS first_chunk FROM men GROUP BY entity HAVING count(DISTINCT id) >= 5""")
def fast_entities(spark, d):
    """Rule-based entities of all chunks with how many hold them."""
    return mentions_of(load(spark, d, "documents"), "doc_id").groupBy("entity").agg(F.count_distinct("id").alias("n_chunks"), F.min("id").alias("first_chunk")).filter("n_chunks >= 5")


_TRIGGERS = "(VALUES ('search', 'intent', 0.95::DOUBLE, 1), ('plan', 'intent', 0.7, 2), ('search', 'pattern', 0.8, 3), ('web', 'pattern', 0.8, 4), ('plan', 'keyword', 0.6, 5), ('log', 'keyword', 0.6, 6), ('watch', 'always', 1.0, 7)) t(skill, source, confidence, seq)"


@query(f"""SELECT conv_id, turn, skill, source, confidence FROM (SELECT conv_id, turn, skill, source, confidence, row_number() OVER (PARTITION BY conv_id, turn, skill ORDER BY confidence DESC, seq) AS r FROM conversations JOIN {_TRIGGERS} ON
CASE source WHEN 'intent' THEN role = 'user' WHEN 'pattern' THEN regexp_matches(text, 'th|qu') WHEN 'keyword' THEN contains(lower(text), 'on') ELSE true END) WHERE r = 1""")
def triggered_skills(spark, d):
    """Skills that a query triggers, each by its surest trigger, the first of equals."""
    table = [("search", "intent", 0.95, 1), ("plan", "intent", 0.7, 2), ("search", "pattern", 0.8, 3), ("web", "pattern", 0.8, 4), ("plan", "keyword", 0.6, 5), ("log", "keyword", 0.6, 6), ("watch", "always", 1.0, 7)]
    triggers = F.broadcast(spark.createDataFrame(table, "skill string, source string, confidence double, seq int"))  # a fixed table
    fires = F.when(F.col("source") == "intent", F.col("role") == "user").when(F.col("source") == "pattern", F.col("text").rlike("th|qu")).when(F.col("source") == "keyword", F.lower("text").contains("on")).otherwise(True)
    rows = load(spark, d, "conversations").crossJoin(triggers).filter(fires)
    w = Window.partitionBy("conv_id", "turn", "skill").orderBy(F.desc("confidence"), "seq")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("conv_id", "turn", "skill", "source", "confidence")
