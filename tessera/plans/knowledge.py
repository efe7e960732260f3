"""Knowledge queries: recommendations, bitemporal neighbours, relation overrides, exports, explanations, archives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import knowledge as kn
from tessera.plans.graph import _BOTH, _SUPPLY, both_ways, seeds
from tessera.plans.registry import query
from tessera.session import small
from tessera.sources.tables import events, load, supply_edges


@query("""SELECT node, other, kind, n, least(n / 5.0::DOUBLE, 1.0)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other, kind) AS r FROM (SELECT l_suppkey AS node, l_partkey AS other, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r <= 5""")
def recommend_by_relationships(spark, d):
    """Each supplier's neighbours and kinds of edge that occur most."""
    rows = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("other"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("node").orderBy(F.desc("n"), "other", "kind")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("node", "other", "kind", "n", F.least(F.col("n") / 5.0, F.lit(1.0)).alias("score"))


@query("""WITH g AS (SELECT l_partkey AS k, count(*) AS degree FROM lineitem GROUP BY 1), t AS (SELECT p_type, p_partkey AS other, degree, row_number() OVER (PARTITION BY p_type ORDER BY degree DESC, p_partkey) AS r FROM part JOIN g ON k = p_partkey),
x AS (SELECT a.p_partkey AS node, other, degree, row_number() OVER (PARTITION BY a.p_partkey ORDER BY degree DESC, other) AS rank FROM part a JOIN t USING (p_type) WHERE r <= 6 AND other <> a.p_partkey) SELECT node, other, degree, least(degree / 15.0::DOUBLE, 1.0)::DOUBLE AS score FROM x WHERE rank <= 5""")
def recommend_by_attributes(spark, d):
    """Each part's best connected others of its type."""
    degree = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("other")).agg(F.count("*").alias("degree"))
    part = load(spark, d, "part").select("p_partkey", "p_type")
    best = part.join(degree, F.col("p_partkey") == F.col("other")).withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("degree"), "other"))).filter("r <= 6").select("p_type", "other", "degree")
    rows = part.join(small(best), "p_type").filter("other <> p_partkey")  # six rows a type
    w = Window.partitionBy("p_partkey").orderBy(F.desc("degree"), "other")
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 5").select(F.col("p_partkey").alias("node"), "other", "degree", F.least(F.col("degree") / 15.0, F.lit(1.0)).alias("score"))


_VALID = """cu AS (SELECT o_custkey AS id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), su AS (SELECT l_suppkey AS id, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1),
re AS (SELECT o_custkey AS src, l_suppkey AS dst, min(o_orderdate) AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def validity(spark, d):
    """Customers, suppliers and their relations with the times at which they hold."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    ends = lambda key, ts: [F.min(ts).alias("valid_from"), F.max(ts).alias("valid_to")]
    cu = o.groupBy(F.col("o_custkey").alias("id")).agg(*ends("id", "o_orderdate"))
    su = li.groupBy(F.col("l_suppkey").alias("id")).agg(*ends("id", "l_shipdate"))
    both = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return cu, both.agg(F.min("o_orderdate").alias("valid_from"), F.max("l_shipdate").alias("valid_to")), su


@query(f"WITH {_VALID}, t AS (SELECT TIMESTAMP '1996-06-01' AS t) SELECT src, dst FROM re, t JOIN cu ON cu.id = src JOIN su ON su.id = dst WHERE re.a <= t AND re.b > t AND cu.a <= t AND cu.b > t AND su.a <= t AND su.b > t")
def temporal_neighbours(spark, d):
    """Relations that hold at an instant together with both their ends."""
    return kn.neighbours_at(*validity(spark, d), F.lit("1996-06-01").cast("timestamp_ntz"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def orphan_chunk_fix(spark, d):
    """Chunks without those that no entity refers to."""
    return load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, event_id, ts FROM documents JOIN events ON user_id = doc_id ORDER BY ts DESC, event_id LIMIT 20")
def override_history(spark, d):
    """The latest changes of documents with what they changed."""
    rows = load(spark, d, "documents").select("doc_id").join(events(spark, d), F.col("doc_id") == F.col("user_id"))
    return rows.orderBy(F.desc("ts"), "event_id").limit(20).select("doc_id", "event_id", "ts")


@query("SELECT n_regionkey AS community, n_name AS name FROM nation")
def community_entities(spark, d):
    """Members of communities, given as lists of ids."""
    nation = load(spark, d, "nation")
    lists = nation.groupBy(F.col("n_regionkey").alias("community")).agg(F.collect_list("n_nationkey").alias("ids"))
    return lists.select("community", F.explode("ids").alias("n_nationkey")).join(nation, "n_nationkey").select("community", F.col("n_name").alias("name"))


@query("""WITH r AS (SELECT user_id AS source, event_id % 50 AS target, upper(replace(event_type, ' ', '_')) AS t FROM events), m AS (SELECT source, target, CASE t WHEN 'CLICK' THEN 'TOUCHES' WHEN 'VIEW' THEN 'SEES' WHEN 'PURCHASE' THEN 'BUYS' ELSE t END AS kind FROM r)
SELECT least(source, target) AS a, greatest(source, target) AS b, kind, count(*) AS n FROM m WHERE source <> target GROUP BY ALL""")
def relation_overrides(spark, d):
    """Relations typed by a person's override, else by the synonyms, else as they are; both directions are one."""
    overrides, synonyms = {"CLICK": "TOUCHES"}, {"CLICK": "USES", "VIEW": "SEES", "PURCHASE": "BUYS"}
    rows = events(spark, d).select(F.col("user_id").alias("source"), (F.col("event_id") % 50).alias("target"), kn.overridden(F.col("event_type"), overrides, synonyms).alias("kind"))
    pair = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    return rows.filter("source <> target").groupBy(*pair, "kind").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(n * 0.3) THEN 'D1' WHEN k <= n - floor(n * 0.2) THEN 'D2' ELSE 'D3' END AS difficulty FROM r""")
def difficulty_rebalance(spark, d):
    """Difficulties dealt anew in a hashed order: 30 % D1, 20 % D3 and the rest D2."""
    return kn.dealt(load(spark, d, "documents").select("doc_id"), "doc_id", 0.3, 0.2, 7)


@query("""WITH h AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id || ':9'), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM documents), w AS (SELECT *, CASE WHEN lang = 'fr' THEN 0.1 WHEN lang = 'de' THEN 0.2 ELSE 0.5 END::DOUBLE AS a, CASE WHEN lang = 'fr' THEN 0.5 WHEN lang = 'de' THEN 0.7 ELSE 0.85 END::DOUBLE AS b FROM h)
SELECT doc_id, CASE WHEN u < a THEN 'D1' WHEN u < b THEN 'D2' ELSE 'D3' END AS difficulty FROM w""")
def difficulty_weights(spark, d):
    """A difficulty by the weights of the question's type, drawn by a hash."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("9"))), 1, 7), 16, 10).cast("bigint") / 268435456.0
    a = F.when(F.col("lang") == "fr", 0.1).when(F.col("lang") == "de", 0.2).otherwise(0.5)
    b = F.when(F.col("lang") == "fr", 0.5).when(F.col("lang") == "de", 0.7).otherwise(0.85)
    return load(spark, d, "documents").select("doc_id", F.when(u < a, "D1").when(u < b, "D2").otherwise("D3").alias("difficulty"))


@query("""WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS g FROM (SELECT DISTINCT p_type FROM part))
SELECT 'd3' AS format, to_json({'id': 'p' || p_partkey, 'label': p_name, 'type': p_type, 'group': g})::VARCHAR AS item FROM part JOIN t USING (p_type)
UNION ALL SELECT 'cytoscape', to_json({'data': {'id': 'p' || p_partkey, 'label': p_name, 'type': p_type}})::VARCHAR FROM part
UNION ALL SELECT 'vis', to_json({'id': 'p' || p_partkey, 'label': p_name, 'title': p_name, 'group': p_type})::VARCHAR FROM part""")
def graph_export(spark, d):
    """Nodes in the shapes of three drawing libraries, one JSON row each."""
    nodes = load(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return kn.drawn_nodes(nodes)


@query(f"""WITH {_SUPPLY} SELECT 'd3' AS format, to_json({{'source': src, 'target': dst, 'type': 'SUPPLIES', 'value': 1}})::VARCHAR AS item FROM sup
UNION ALL SELECT 'cytoscape', to_json({{'data': {{'id': 'edge_' || src || dst, 'source': src, 'target': dst, 'label': 'SUPPLIES'}}}})::VARCHAR FROM sup
UNION ALL SELECT 'vis', to_json({{'id': src || dst, 'from': src, 'to': dst, 'label': 'SUPPLIES', 'title': 'SUPPLIES'}})::VARCHAR FROM sup""")
def edge_export(spark, d):
    edges = supply_edges(spark, d).select(F.concat("src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("SUPPLIES").alias("type"))
    return kn.drawn_edges(edges)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'Americas' ELSE 'r' || n_regionkey END AS label FROM nation")
def community_labels(spark, d):
    """New labels of communities set on their members."""
    rows = load(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("community"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("label"))
    return kn.relabelled(rows, spark.createDataFrame([(1, "Americas")], "community int, new string")).select("n_nationkey", "label")


@query("""SELECT id, name, CASE WHEN id = 3 THEN 'set' ELSE note END AS note FROM (SELECT n_nationkey::BIGINT AS id, coalesce(CASE WHEN n_nationkey = 2 THEN 'MERGED' END, n_name) AS name, '' AS note FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'NEW', '')""")
def pattern_updates(spark, d):
    """Create, merge, set and delete as rewrites of the node table."""
    nodes = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("note"))
    new = spark.createDataFrame([(100, "NEW", ""), (2, "MERGED", "")], nodes.schema)
    merged = kn.merged(nodes, new, "id", ["name"])
    changed = kn.set_where(merged, F.col("id") == 3, {"note": F.lit("set")})
    return kn.deleted(changed, F.col("id") == 4)


@query(f"""WITH {_BOTH}, n AS (SELECT count(DISTINCT src) AS n FROM und) SELECT src AS node, count(*) AS degree, round(count(*) / (any_value(n) - 1)::DOUBLE, 9) AS degree_share FROM und, n GROUP BY src HAVING src IN (SELECT 's' || s_suppkey FROM supplier)""")
def centrality_report(spark, d):
    """Degree of suppliers, plain and as a share of all other nodes."""
    both = both_ways(spark, d)
    n = both.select("src").distinct().count()
    return both.filter(F.col("src").startswith("s")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.round(F.count("*") / F.lit(max(n - 1, 1)), 9).alias("degree_share"))


_VER = "v AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)"


def versions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("user_id", "event_id", "event_type", "value", F.row_number().over(w).alias("version"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query(f"""WITH {_VER}, n AS (SELECT user_id, max(version) AS last FROM v GROUP BY 1), t AS (SELECT v.* FROM v WHERE version = 2)
SELECT user_id, version::BIGINT AS version, event_type, value, CASE WHEN version = last THEN TIMESTAMP '2024-02-01' ELSE until END AS valid_to, '' AS reason FROM v JOIN n USING (user_id) WHERE last >= 2
UNION ALL SELECT user_id, last + 1, event_type, value, NULL, 'undo (reverted to version 2)' FROM t JOIN n USING (user_id)""")
def revert_versions(spark, d):
    """Every entity back to its second version: a new version with the old payload, the open one closed."""
    rows = versions(spark, d)
    known = rows.filter("version = 2").select("user_id")
    out = kn.reverted(rows.join(known, "user_id", "left_semi"), "user_id", 2, F.lit("2024-02-01").cast("timestamp_ntz"), "undo", ["event_type", "value"])
    return out.select("user_id", F.col("version").cast("long").alias("version"), "event_type", "value", "valid_to", "reason")


@query(f"WITH {_VER} SELECT user_id, version, event_type FROM v WHERE ts <= TIMESTAMP '2024-01-15' AND (until IS NULL OR until > TIMESTAMP '2024-01-15')")
def at_valid_time(spark, d):
    """What held at an instant, whenever it became known."""
    return kn.at_time(versions(spark, d), F.lit("2024-01-15").cast("timestamp_ntz"), "valid_from", "valid_to").select("user_id", "version", "event_type")


@query(f"WITH {_VER}, k AS (SELECT *, ts + INTERVAL 2 HOUR AS tf, until + INTERVAL 2 HOUR AS tt FROM v) SELECT user_id, version, event_type FROM k WHERE tf <= TIMESTAMP '2024-01-15' AND (tt IS NULL OR tt > TIMESTAMP '2024-01-15')")
def at_transaction_time(spark, d):
    """What was known at an instant (facts become known two hours late)."""
    late = F.expr("INTERVAL 2 HOURS")
    rows = versions(spark, d).withColumns({"transaction_from": F.col("valid_from") + late, "transaction_to": F.col("valid_to") + late})
    return kn.at_time(rows, F.lit("2024-01-15").cast("timestamp_ntz"), "transaction_from", "transaction_to").select("user_id", "version", "event_type")


_JUDGED = "j AS (SELECT source, doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {_JUDGED} SELECT source, round(coalesce(avg(quality), 1.0), 6) AS context_recall, round(coalesce(avg(1 - toxic), 1.0), 6) AS faithfulness, round(coalesce(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0)::DOUBLE, 0.0), 6) AS hallucination, coalesce(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0)::DOUBLE, 0.0) > 0.1 AS flagged FROM j GROUP BY source""")
def answer_metrics(spark, d):
    """Recall, faithfulness and hallucination of answers from judged statements; answers without one count 1, 1 and 0."""
    rows = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id", "left")
    return kn.answer_metrics(rows, "source", F.col("quality"), F.col("toxic") == 0)


@query("SELECT doc_id, source, substr(text, 1, 200) AS excerpt, coalesce(quality, 0) AS relevance, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'used' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def attribution(spark, d):
    """What a trace cites of each chunk: source, beginning, relevance (0 where missing) and why."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return kn.attributions(rows, F.col("quality"), F.when(F.col("toxic") == 1, "flagged").otherwise("used"))


@query("""SELECT event_id, 'user' AS level, event_type AS shown FROM events UNION ALL SELECT event_id, 'expert', event_type || ' ' || user_id FROM events UNION ALL SELECT event_id, 'audit', event_type || ' ' || user_id || ' ' || event_id FROM events""")
def explanation_levels(spark, d):
    """A trace as users, experts and auditors see it."""
    rows = events(spark, d)
    shown = {"user": ["event_type"], "expert": ["event_type", "user_id"], "audit": ["event_type", "user_id", "event_id"]}
    parts = [rows.select("event_id", F.lit(level).alias("level"), F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("shown")) for level, names in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH g AS (SELECT user_id, list(DISTINCT event_type) AS granted FROM events WHERE value < 30 GROUP BY user_id) SELECT user_id, list_contains(granted, 'view') AND list_contains(granted, 'purchase') AS active FROM g""")
def skill_consent(spark, d):
    """A skill is active for a subject if every category it needs has a valid consent."""
    granted = events(spark, d).filter("value < 30").groupBy("user_id").agg(F.collect_set("event_type").alias("granted"))
    return granted.select("user_id", kn.consented(F.array(F.lit("view"), F.lit("purchase")), F.col("granted")).alias("active"))


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part), b AS (SELECT unnest(['red bolt', 'hot gear']) AS name), r AS (SELECT l_partkey AS s, l_suppkey AS t FROM lineitem)
SELECT count(*) AS kept, count(*) FILTER (a.name IN (SELECT name FROM b)) AS half FROM r JOIN e a ON a.id = s JOIN e c ON c.id = t WHERE NOT (a.name IN (SELECT name FROM b) AND c.name IN (SELECT name FROM b))""")
def artifact_filter(spark, d):
    """Relations without those of which both ends are on the block list."""
    names = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("t"))
    rows = rows.join(names.withColumnsRenamed({"id": "s", "name": "a"}), "s").join(names.withColumnsRenamed({"id": "t", "name": "c"}), "t")
    kept = kn.without_artifacts(rows, "a", "c", ("red bolt", "hot gear"))
    return kept.agg(F.count("*").alias("kept"), F.count_if(F.col("a").isin("red bolt", "hot gear")).alias("half"))


@query("""SELECT doc_id, 'default' AS namespace, lang, source AS text_source, CASE WHEN doc_id % 2 = 0 THEN 'over' ELSE substr(text, 1, 20) END AS body FROM documents""")
def chunk_payload(spark, d):
    """Chunks as flat payloads: metadata overrides fields of the same name, a missing namespace is the default one."""
    rows = load(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("text_source"), F.substring("text", 1, 20).alias("body"), F.lit(None).cast("string").alias("namespace"))
    rows = rows.withColumn("metadata", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("body"), F.lit("over"))))
    return kn.payload(rows, "metadata", ["body"]).select("doc_id", "namespace", "lang", "text_source", "body")


@query("""WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN last < 5 THEN 'archived' ELSE 'kept' END AS place, count(*) AS n FROM conversations JOIN c USING (conv_id) GROUP BY ALL""")
def conversation_archive(spark, d):
    """Conversations that have rested are moved to the archive, the others stay."""
    rows = load(spark, d, "conversations")
    cold, hot = kn.archived(rows, "conv_id", F.max("turn") < 5)
    both = cold.withColumn("place", F.lit("archived")).unionByName(hot.withColumn("place", F.lit("kept")))
    return both.groupBy("conv_id", "place").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url, 0.0::DOUBLE AS score, TRY_CAST(CASE WHEN page_id % 2 = 0 THEN '2024-03-0' || (page_id % 9 + 1) ELSE 'soon' END AS DATE) AS published FROM pages""")
def web_results(spark, d):
    """Web results under the engine's names: a date or null, score 0."""
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("2024-03-0"), F.col("page_id") % 9 + 1)).otherwise("soon")
    rows = load(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("url"), raw.alias("date"))
    return rows.select("page_id", "title", "url", F.lit(0.0).alias("score"), F.col("date").try_cast("date").alias("published"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split('# ' || replace(text, chr(10), chr(10) || '## '), chr(10)) AS ls FROM documents))
SELECT doc_id, line::BIGINT AS line_no, length(regexp_extract(t, '^(#{1,6})\\s', 1))::BIGINT AS level, trim(regexp_replace(t, '^#{1,6}\\s+', '')) AS heading FROM l WHERE regexp_matches(t, '^#{1,6}\\s+\\S')""")
def markdown_sections(spark, d):
    """Headings of Markdown with level and line."""
    from tessera.sources.sections import markdown_sections as read

    text = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    rows = load(spark, d, "documents").select("doc_id", text.alias("text"))
    return read(rows, "doc_id", "text")


_TABLE = "'<table><tr><th> A </th><th>B</th></tr><tr><td>' || c_name || '</td><td>  x <b>' || c_custkey || '</b></td></tr></table>'"


@query(f"""SELECT c_custkey, 0 AS table_no, 1::BIGINT AS row_no, c_name || '|x ' || c_custkey AS cells FROM customer UNION ALL SELECT c_custkey, 0, 0, 'A|B' FROM customer""")
def html_tables(spark, d):
    """Rows of HTML tables: tags stripped, white space collapsed."""
    from tessera.sources.sections import html_tables as read

    html = F.concat(F.lit("<table><tr><th> A </th><th>B</th></tr><tr><td>"), "c_name", F.lit("</td><td>  x <b>"), "c_custkey", F.lit("</b></td></tr></table>"))
    rows = read(load(spark, d, "customer").select("c_custkey", html.alias("html")), "c_custkey", "html")
    return rows.select("c_custkey", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query("""SELECT page_id, kind, level, heading, page_no FROM (SELECT page_id, 'docx' AS kind, CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS level, 'h' || page_id AS heading, NULL::INT AS page_no FROM pages
UNION ALL SELECT page_id, 'pdf', 1, 'p' || page_id, (page_id % 7)::INT FROM pages UNION ALL SELECT page_id, 'none', 1, 'Document', NULL FROM pages)""")
def parsed_sections(spark, d):
    """Sections that parsers found: heading styles to levels, page numbers, and one section where there is none."""
    from tessera.sources import sections as se

    pages = load(spark, d, "pages")
    style = F.element_at(F.array(*[F.lit(x) for x in ("Heading 1", "Heading 2", "Heading 3", "Fancy")]), (F.col("page_id") % 4 + 1).cast("int"))
    one = lambda **f: F.array(F.struct(*[v.alias(k) for k, v in f.items()]))
    docx = pages.select("page_id", one(heading=F.concat(F.lit("h"), F.col("page_id")), style=style, level=F.lit(None).cast("int"), page_no=F.lit(None).cast("int")).alias("sections"))
    pdf = pages.select("page_id", one(heading=F.concat(F.lit("p"), F.col("page_id")), style=F.lit(None).cast("string"), level=F.lit(None).cast("int"), page_no=(F.col("page_id") % 7).cast("int")).alias("sections"))
    none = docx.withColumn("sections", F.slice("sections", 1, 0))
    parts = [se.section_rows(rows, "page_id", "sections").withColumn("kind", F.lit(kind)) for kind, rows in (("docx", docx), ("pdf", pdf), ("none", none))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("page_id", "kind", "level", "heading", "page_no")


@query(f"""WITH {_BOTH}, t AS (SELECT 'orphans' AS template, count(*) AS n FROM part WHERE 'p' || p_partkey NOT IN (SELECT src FROM und)
UNION ALL SELECT 'highly_connected', count(*) FROM (SELECT src FROM und GROUP BY src HAVING count(*) >= 20) UNION ALL SELECT 'degree_distribution', count(DISTINCT c) FROM (SELECT count(*) AS c FROM und GROUP BY src)
UNION ALL SELECT 'neighbours', count(*) FROM und WHERE src = 's1' UNION ALL SELECT 'by_type', count(*) FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 'search', count(*) FROM part WHERE contains(lower(p_name), 'bolt')
UNION ALL SELECT 'subgraph_edges', count(*) FROM und a WHERE src IN (SELECT dst FROM und WHERE src = 's1' UNION SELECT 's1') AND dst IN (SELECT dst FROM und WHERE src = 's1' UNION SELECT 's1')) SELECT * FROM t""")
def graph_templates(spark, d):
    """Stock questions on a graph as one plan, each answer under its template's name."""
    part = load(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    t = kn.Templates(both_ways(spark, d), part)
    return kn.batch({
        "orphans": t.orphans(), "highly_connected": t.highly_connected(20), "degree_distribution": t.degree_distribution(), "neighbours": t.neighbours("s1"),
        "by_type": t.by_kind("SMALL"), "search": t.search("bolt"), "subgraph_edges": t.subgraph("s1"),
    })


@query("""WITH s AS (SELECT doc_id AS id, source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY source) AS top_id FROM documents)
SELECT id AS src, next_id AS dst, 'FOLLOWS' AS kind FROM s WHERE next_id IS NOT NULL UNION ALL SELECT top_id, id, 'PARENT_OF' FROM s WHERE k > 1""")
def section_graph(spark, d):
    """Edges of sections: the next one in order, and the first one as parent."""
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document"), F.when(F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("source")), 1).otherwise(2).alias("level"))
    return kn.section_edges(rows, "document", "id", "level")


@query(f"""WITH {_BOTH}, c AS (SELECT src AS node, min(dst) AS community FROM und GROUP BY src), m AS (SELECT count(*) AS m FROM und), k AS (SELECT community, sum(k) AS k FROM (SELECT src AS node, count(*) AS k FROM und GROUP BY src) JOIN c USING (node) GROUP BY community),
i AS (SELECT a.community, count(*) AS i FROM und JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.community = b.community GROUP BY 1) SELECT round(sum(coalesce(i, 0) / m::DOUBLE - (k / m::DOUBLE) * (k / m::DOUBLE)), 9) AS modularity FROM k LEFT JOIN i USING (community), m""")
def modularity(spark, d):
    """Modularity of the communities that share a least neighbour."""
    both = both_ways(spark, d)
    members = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("community"))
    return g.modularity(supply_edges(spark, d), members).select(F.round("modularity", 9).alias("modularity"))


@query()
def domain_clusters(spark, d):
    """KMeans domains of vectors with sizes and silhouette; a fixed seed."""
    return kn.clusters(load(spark, d, "embeddings"), 10).groupBy("cluster").agg(F.count("*").alias("n"), F.first("silhouette").alias("silhouette"))


@query()
def coreference(spark, d):
    """Pronouns replaced by the capitalised word before them, by one pattern; ``coreference_rewrite`` scores antecedents."""
    return load(spark, d, "conversations").select("conv_id", "turn", kn.resolved(F.col("text")).alias("resolved"))


@query("""SELECT event_id, to_json({'type': 'progress', 'data': {'user': user_id, 'phase': event_type, 'percent': round(value, 1)}})::VARCHAR AS sse FROM events""")
def progress_payload(spark, d):
    """Progress events as nested JSON."""
    data = F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("phase"), F.round("value", 1).alias("percent"))
    return events(spark, d).select("event_id", F.to_json(F.struct(F.lit("progress").alias("type"), data.alias("data"))).alias("sse"))


@query(f"""WITH {_BOTH}, x AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey < 3), e AS (SELECT DISTINCT dst AS node FROM x JOIN und ON src = x.node) SELECT count(*) AS n FROM und WHERE src IN (SELECT node FROM e) AND dst IN (SELECT node FROM x)""")
def subgraph_between(spark, d):
    """Edges of a subgraph given by a first set of nodes and their neighbours."""
    own = seeds(spark, d, 3)
    both = both_ways(spark, d)
    near = both.join(F.broadcast(own.withColumnRenamed("node", "src")), "src").select(F.col("dst").alias("src")).distinct()  # three rows
    return both.join(near, "src", "left_semi").join(F.broadcast(own.withColumnRenamed("node", "dst")), "dst", "left_semi").agg(F.count("*").alias("n"))
