"""Ingestion, resolution and reranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import entities as en
from tessera.operators import retrieval as r
from tessera.plans.chain import Chain
from tessera.plans.registry import query
from tessera.plans.retrieval import BM25_SQL, ENTITY_SQL, FEEDBACK, asked, dense, global_ranks, local_ranks
from tessera.session import saved
from tessera.sources import readers
from tessera.sources.tables import events, load


@query("""SELECT page_id, CASE WHEN s IN ('pdf', 'docx', 'pptx', 'html', 'htm') THEN 'layout' WHEN s IN ('txt', 'md', 'rst', 'log') THEN 'text' WHEN s IN ('csv', 'tsv', 'xlsx') THEN 'table' WHEN s IN ('json', 'jsonl', 'xml', 'yaml') THEN 'data' WHEN s IN ('png', 'jpg', 'jpeg', 'tiff') THEN 'image' ELSE 'unsupported' END AS parser
FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '\\?.*$', '') || (['.pdf', '.md', '.csv', '', '.bin'])[page_id % 5 + 1], '\\.([A-Za-z0-9]+)$', 1)) AS s FROM pages)""")
def format_dispatch(spark, d):
    """The parser of each path by its suffix."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".md", ".csv", "", ".bin")]), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.regexp_replace("url", r"\?.*$", ""), ends)
    return load(spark, d, "pages").select("page_id", readers.parser_of(path).alias("parser"))


@query("""SELECT doc_id, source AS src, regexp_replace(lang || '/x/data/' || source, '^.*data', '') AS path, n_chars::BIGINT AS n FROM documents""")
def metadata_cleaning(spark, d):
    """Allowed keys only; paths are cut behind the last ``data``."""
    rows = load(spark, d, "documents")
    path = F.regexp_replace(F.concat("lang", F.lit("/x/data/"), "source"), "^.*data", "")
    return rows.select("doc_id", F.col("source").alias("src"), path.alias("path"), F.col("n_chars").alias("n"))


@query()
def adaptive_chunks(spark, d):
    """A document's paragraphs as sections, merged to chunks; tests compare the fold with a loop."""
    lines = F.posexplode(F.split("text", "\n")).alias("seq", "text")
    rows = load(spark, d, "documents").select("doc_id", lines).withColumn("tokens", F.floor(F.length("text") / 4).cast("long"))
    rows = rows.withColumn("heading", F.substring("text", 1, 40))
    return en.section_chunks(rows).select("doc_id", "chunk_no", F.size("headings").cast("long").alias("n_sections"), "tokens")


_ENTITY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query(f"""WITH RECURSIVE n AS (SELECT p_partkey AS id, p_brand AS kind, {_ENTITY.format("CASE WHEN p_partkey % 7 = 0 THEN p_name || 's' WHEN p_partkey % 7 = 1 THEN 'x' || p_name ELSE p_name END")} AS key FROM part),
x AS (SELECT kind, key, min(id) AS rep FROM n GROUP BY ALL),
l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.kind = b.kind AND a.key <> b.key WHERE (least(length(a.key), length(b.key)) >= 5 AND levenshtein(a.key, b.key) <= 2) OR (least(length(a.key), length(b.key)) >= 6 AND (contains(a.key, b.key) OR contains(b.key, a.key)))),
r AS (SELECT rep AS id, rep AS c FROM x UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a), m AS (SELECT id, min(c) AS canonical FROM r GROUP BY id)
SELECT n.id AS id, canonical FROM n JOIN x ON x.kind = n.kind AND x.key = n.key JOIN m ON m.id = x.rep""")
def entity_resolution(spark, d):
    """Part names with typing errors resolved by edits and containment."""
    k = F.col("p_partkey") % 7
    name = F.when(k == 0, F.concat("p_name", F.lit("s"))).when(k == 1, F.concat(F.lit("x"), "p_name")).otherwise(F.col("p_name"))
    names = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), name.alias("name"))
    return en.same_entities(names)


@query("""SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
SELECT user_id AS qid, event_id AS id, round(ws * (value / 100) + wk * ((event_id % 10) / 10.0::DOUBLE) + wr * coalesce(exp(-date_diff('day', ts::DATE, DATE '2024-02-01') / 180.0::DOUBLE), 0.5), 6) AS score
FROM events JOIN (VALUES ('click', 0.7::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE), ('view', 0.3::DOUBLE, 0.6::DOUBLE, 0.1::DOUBLE), ('purchase', 0.4::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE)) p(intent, ws, wk, wr) ON intent = event_type)) WHERE rank <= 5""")
def adaptive_rerank(spark, d):
    """Three scores weighted by the intent's profile."""
    profiles = spark.createDataFrame([("click", 0.7, 0.2, 0.1), ("view", 0.3, 0.6, 0.1), ("purchase", 0.4, 0.2, 0.4)], "intent string, ws double, wk double, wr double")
    rows = events(spark, d).select(
        F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.col("event_type").alias("intent"), (F.col("value") / 100).alias("semantic"),
        (F.col("event_id") % 10 / 10.0).alias("keyword"), F.col("ts").cast("date").alias("created_at"),
    )
    return en.adaptive_rerank(rows, profiles, "2024-02-01", 5).select("qid", "id", "score", "rank")


#: Channel weights of each intent: vector, keyword, graph local, graph global (fixed values).
PROFILES = [("factual", 0.3, 0.3, 0.4, 0.0), ("keyword", 0.1, 0.6, 0.3, 0.0), ("exploratory", 0.2, 0.1, 0.2, 0.5), ("summary", 0.1, 0.0, 0.1, 0.8)]
_PROFILES = ", ".join("('" + p[0] + "', " + ", ".join(f"{x}::DOUBLE" for x in p[1:]) + ")" for p in PROFILES)


@query(f"""WITH {BM25_SQL}, {ENTITY_SQL}, w AS (SELECT * FROM (VALUES {_PROFILES}) t(intent, wv, wb, wl, wg)),
bmr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm), a AS (SELECT qid, id, 'b' AS ch, rank FROM bmr), {FEEDBACK.format(k=20)},
v AS (SELECT qid, id, 'v' AS ch, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dn),
un AS (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM v WHERE rank <= 20 UNION ALL SELECT qid, id, 'l', rank FROM local_ WHERE rank <= 20 UNION ALL SELECT qid, id, 'g', rank FROM global_ WHERE rank <= 20),
s AS (SELECT intent, qid, id, round(sum(CASE ch WHEN 'v' THEN wv WHEN 'b' THEN wb WHEN 'l' THEN wl ELSE wg END / (60 + rank)), 9) AS score FROM un, w GROUP BY ALL)
SELECT intent, qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY intent, qid ORDER BY score DESC, id) AS k FROM s) WHERE k <= 3""")
def four_way_profiles(spark, d):
    """Vector, keyword, graph local and graph global channels weighted by each intent's profile."""
    from pyspark.sql import Window

    words = saved(r.bm25_top(load(spark, d, "documents"), asked(spark, d), 20))
    parts = {"b": words, "v": dense(spark, d, words, 20), "l": local_ranks(spark, d, 20), "g": global_ranks(spark, d, 20)}
    every = r.all_of([rows.select("qid", "id", F.lit(ch).alias("ch"), "rank") for ch, rows in parts.items()])
    profiles = spark.createDataFrame(PROFILES, "intent string, v double, b double, l double, g double")
    weight = F.coalesce(*[F.when(F.col("ch") == c, F.col(c)) for c in parts])
    scored = every.crossJoin(F.broadcast(profiles)).groupBy("intent", "qid", "id").agg(F.round(F.sum(weight / (60 + F.col("rank"))), 9).alias("score"))  # four rows
    w = Window.partitionBy("intent", "qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("intent", "qid", "id", "score")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type")
def chain_dsl(spark, d):
    """A serialised chain of steps."""
    chain = Chain().step("large", "filter", condition="value > 10").step("by_kind", "count", keys=["event_type"])
    return Chain.from_json(chain.to_json()).apply(events(spark, d))


@query("""SELECT a.event_id, coalesce(ca.canonical, a.event_type) AS source, coalesce(cb.canonical, 'click') AS target FROM events a LEFT JOIN (VALUES ('click', 'C'), ('view', 'V')) ca(name, canonical) ON ca.name = lower(trim(a.event_type)) LEFT JOIN (VALUES ('click', 'C'), ('view', 'V')) cb(name, canonical) ON cb.name = 'click'""")
def reference_remap(spark, d):
    """Both ends of relations replaced by their canonical names."""
    mapping = spark.createDataFrame([("click", "C"), ("view", "V")], "name string, canonical string")
    rows = events(spark, d).select("event_id", F.col("event_type").alias("source"), F.lit("click").alias("target"))
    return en.remap(rows, mapping).select("event_id", "source", "target")
