"""Benchmark sets and exports as queries: the driver's tables in the shapes of the public sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.filters import MetadataFilter, namespace_kind
from tessera.plans.registry import query
from tessera.sources import readers
from tessera.sources.tables import events, load

_SHAPE = "question_id, question, answer, len(contexts) AS n_contexts, contexts[1] AS first_context, source"


def shaped(rows):
    return rows.select("question_id", "question", "answer", F.size("contexts").cast("long").alias("n_contexts"), F.get("contexts", F.lit(0)).alias("first_context"), "source")


_NQ = "SELECT conv_id * 1000 + turn AS id, role || '?' AS question, string_split(text, ' ') AS toks, turn FROM conversations"


@query(f"""SELECT {_SHAPE} FROM (SELECT 'nq_' || id AS question_id, question, CASE WHEN turn % 3 = 0 THEN 'short' WHEN turn % 3 = 1 THEN 'yes' END AS answer, [array_to_string(list_filter(toks[1:2000], lambda t: NOT regexp_matches(t, '^<.*>$')), ' ')] AS contexts, 'nq' AS source FROM ({_NQ})) WHERE answer IS NOT NULL AND trim(contexts[1]) <> ''""")
def nq_samples(spark, d):
    """Short answer, else yes or no, else dropped."""
    rows = load(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("role", F.lit("?")).alias("question"), F.split("text", " ").alias("tokens"),
        F.when(F.col("turn") % 3 == 0, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("short_answers"),
        F.when(F.col("turn") % 3 == 1, "YES").otherwise("NONE").alias("yes_no"),
    )
    return shaped(readers.natural_questions(rows))


@query(f"""SELECT {_SHAPE} FROM (SELECT 'marco_' || doc_id AS question_id, source AS question, lang AS answer, list_filter(CASE WHEN doc_id % 2 = 0 THEN [substr(text, 11, 10)] ELSE [substr(text, 1, 10), substr(text, 11, 10), substr(text, 21, 10)] END, lambda c: trim(c) <> '') AS contexts, 'marco' AS source FROM documents) WHERE coalesce(question, '') <> '' AND coalesce(answer, '') <> '' AND len(contexts) > 0""")
def marco_samples(spark, d):
    """Selected passages, else the first three."""
    piece = lambda k, hit: F.struct(F.substring("text", 10 * k + 1, 10).alias("text"), hit.cast("int").alias("is_selected"))
    even = F.col("doc_id") % 2 == 0
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("query"), F.array("lang").alias("answers"), F.array(piece(0, F.lit(False)), piece(1, even), piece(2, F.lit(False))).alias("passages"))
    return shaped(readers.marco(rows))


@query(f"""SELECT {_SHAPE} FROM (SELECT 'hotpot_' || conv_id AS question_id, 'q' || conv_id AS question, 'a' AS answer, CASE WHEN conv_id % 2 = 0 THEN [list(text ORDER BY turn, role)[1]] ELSE list(text ORDER BY turn, role)[1:3] END AS contexts, 'hotpot' AS source FROM conversations GROUP BY conv_id)""")
def hotpot_samples(spark, d):
    """Supporting sentences, else the first ones."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: r["text"])
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(texts.alias("s"))
    fact = F.struct(F.lit("t").alias("title"), F.lit(0).alias("sentence"))
    facts = F.when(F.col("conv_id") % 2 == 0, F.array(fact)).otherwise(F.slice(F.array(fact), 1, 0))
    rows = rows.select(F.col("conv_id").alias("id"), F.concat(F.lit("q"), "conv_id").alias("question"), F.lit("a").alias("answer"), F.array(F.struct(F.lit("t").alias("title"), F.col("s").alias("sentences"))).alias("paragraphs"), facts.alias("facts"))
    return shaped(readers.hotpot(rows))


@query(f"""SELECT {_SHAPE} FROM (SELECT 'fever_' || doc_id AS question_id, substr(text, 1, 20) AS question, lang AS answer, ['Evidence for: ' || substr(text, 1, 20)] AS contexts, 'fever' AS source FROM documents WHERE text <> '' AND lang IS NOT NULL)
UNION ALL SELECT {_SHAPE} FROM (SELECT 'ragbench_' || doc_id AS question_id, source AS question, lang AS answer, [text] AS contexts, 'ragbench' AS source FROM documents WHERE trim(text) <> '' AND lang IS NOT NULL AND source IS NOT NULL)
UNION ALL SELECT {_SHAPE} FROM (SELECT 'logqa_' || doc_id AS question_id, source AS question, lang AS answer, list_filter(string_split(text, chr(10)), lambda c: trim(c) <> '') AS contexts, 'logqa' AS source FROM documents WHERE trim(text) <> '' AND lang IS NOT NULL AND source IS NOT NULL)""")
def other_samples(spark, d):
    """Claims, answers to documents, and questions on logs."""
    docs = load(spark, d, "documents").withColumnRenamed("doc_id", "id")
    fever = readers.fever(docs.select("id", F.substring("text", 1, 20).alias("claim"), F.col("lang").alias("label")))
    rag = readers.ragbench(docs.select("id", F.col("source").alias("question"), F.col("lang").alias("response"), F.array("text").alias("documents")))
    logs = readers.log_questions(docs.select("id", F.col("source").alias("question"), F.col("lang").alias("answer"), F.col("text").alias("log")))
    return shaped(fever).unionByName(shaped(rag)).unionByName(shaped(logs))


@query("""SELECT doc_id::VARCHAR AS id, lang AS doc_type, length(source)::INT AS question_length, 2 AS context_count, (length(text) + length(source))::INT AS total_context_length FROM documents""")
def sample_manifest(spark, d):
    """The manifest of exported samples."""
    docs = load(spark, d, "documents")
    samples = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("question"), F.col("lang").alias("ground_truth"), F.array("text", "source").alias("contexts"), F.col("lang").alias("doc_type"), F.lit("lookup").alias("question_type"), F.lit("D1").alias("difficulty"))
    return readers.manifest(samples).select("id", "doc_type", "question_length", "context_count", "total_context_length")


@query("""SELECT task, text, labels FROM (SELECT 'entity' AS task, source AS text, '["' || lang || '"]' AS labels FROM documents UNION ALL SELECT 'relation', source, '["' || source || '"]' FROM documents)""")
def training_samples(spark, d):
    """Training rows in both forms."""
    rows = load(spark, d, "documents").select(F.col("source").alias("text"), F.array("lang").alias("entities"), F.array("source").alias("relations"))
    return readers.training_lines(rows)


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels)")
def document_chunks(spark, d):
    """The chunks of one document of a namespace, a section filter before the top-k."""
    rows = load(spark, d, "documents").filter((F.col("source") == "src1") & (F.col("lang") == "en"))
    return rows.join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'ready' ELSE 'pending' END AS state FROM documents")
def refinement_update(spark, d):
    """The pending mark of one document's chunks turned off."""
    rows = load(spark, d, "documents").withColumn("state", F.lit("pending"))
    return rows.select("doc_id", F.when(F.col("source") == "src1", "ready").otherwise(F.col("state")).alias("state"))


@query("SELECT round(greatest(0.01, least(1, 0.3 * 2) * power(0.6, 1)), 6)::DOUBLE AS share, CASE WHEN s IN ('default', 'general') THEN 'general' WHEN starts_with(s, 'src') THEN 'project' ELSE 'custom' END AS kind, s AS namespace FROM (SELECT DISTINCT source AS s FROM documents)")
def filter_selectivity(spark, d):
    """The share of rows that a filter is taken to keep, and the kinds of namespaces."""
    wanted = MetadataFilter(source_in=("src1", "src2"), tags=("x",))
    rows = load(spark, d, "documents").select(F.col("source").alias("namespace")).distinct()
    return rows.select(F.lit(round(wanted.selectivity(), 6)).alias("share"), namespace_kind(F.col("namespace"), {"src": "project"}).alias("kind"), "namespace")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS days FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' GROUP BY event_type""")
def event_log_scan(spark, d):
    """An event log written as JSON lines and scanned again by an inclusive range."""
    import uuid

    from tessera.session import shared_dir

    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows = events(spark, d).select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"))
    readers.append_events(rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")), path)
    found = readers.read_events(spark, path, "2024-01-02", "2024-01-20")
    return found.groupBy(F.col("stage").alias("event_type")).agg(F.count("*").alias("n"), F.count_distinct(F.to_date("timestamp")).alias("days"))


@query("""SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(event_id + user_id)::BIGINT AS tokens FROM events GROUP BY 1""")
def request_ledger(spark, d):
    """Requests appended to a ledger by month and read again."""
    import uuid

    from tessera.session import shared_dir

    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = events(spark, d).select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("provider"), F.col("event_id").alias("tokens_input"), F.col("user_id").alias("tokens_output"))
    readers.append_requests(rows, path)
    return readers.read_requests(spark, path, "2023-01", "2025-01").groupBy("month").agg(F.count("*").alias("n"), F.sum("tokens_total").alias("tokens"))
