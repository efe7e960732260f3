"""Readers and writers beyond the tables: formats, event logs, benchmark sets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parser of each suffix (fixed values); others are refused.
PARSERS = {
    "layout": ("pdf", "docx", "pptx", "html", "htm"),
    "text": ("txt", "md", "rst", "log"),
    "table": ("csv", "tsv", "xlsx"),
    "data": ("json", "jsonl", "xml", "yaml"),
    "image": ("png", "jpg", "jpeg", "tiff"),
}


def suffix(path: Column) -> Column:
    """Lower-cased suffix behind the last dot of the file name; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(path, r"\?.*$", ""), r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def parser_of(path: Column) -> Column:
    """The parser that reads a path, ``unsupported`` where none does."""
    out = F.lit("unsupported")
    for parser, known in reversed(PARSERS.items()):
        out = F.when(suffix(path).isin(*known), parser).otherwise(out)
    return out


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with their parser; contents stay binary until a parser takes them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("parser", parser_of(F.col("path")))


EVENT = "timestamp timestamp, stage string, latency_ms double, tokens_used int, cache_hit boolean, metadata map<string,string>, request_id string, user_id string"


def read_events(spark: SparkSession, path: str, start: str | None = None, stop: str | None = None, stage: str | None = None) -> DataFrame:
    """An event log of JSON lines; malformed lines go, the range is inclusive."""
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    if start:
        rows = rows.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if stop:
        rows = rows.filter(F.col("timestamp") <= F.lit(stop).cast("timestamp"))
    return rows.filter(F.col("stage") == stage) if stage else rows


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def verify_lines(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """One row: valid and invalid lines of a JSON-lines file; a valid one has all required fields."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    fields = F.json_object_keys("value")
    fine = F.coalesce(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), fields)) == 0, F.lit(False))
    return rows.agg(F.count_if(fine).alias("valid"), F.count_if(~fine).alias("invalid"))


def export_csv(rows: DataFrame, path: str, order: str) -> None:
    """A report as one sorted CSV file with a header: for results, not for tables."""
    rows.orderBy(F.desc(order)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: One request of a ledger; the total of tokens and the month are derived.
REQUEST = "timestamp timestamp, provider string, model string, task_type string, task_id string, tokens_input long, tokens_output long, cost_usd double, latency_ms double, routing_reason string, fallback_used boolean"


def append_requests(rows: DataFrame, path: str) -> None:
    """Append requests to a ledger that is partitioned by month."""
    total = rows.withColumn("tokens_total", F.coalesce("tokens_input", F.lit(0)) + F.coalesce("tokens_output", F.lit(0)))
    total.withColumn("month", F.date_format("timestamp", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def read_requests(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A ledger's requests of the months ``first`` to ``last`` (yyyy-MM, inclusive): other months are not read."""
    rows = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    rows = rows.filter(F.col("month") >= first) if first else rows
    return rows.filter(F.col("month") <= last) if last else rows


#: A rerank training pair and a benchmark sample.
PAIR = "query string, intent string, doc_id string, semantic_score double, keyword_score double, recency_score double, relevance_label double"
SAMPLE = "id string, question string, ground_truth string, contexts array<string>, doc_type string, question_type string, difficulty string"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema (training pairs, samples); lines that aren't JSON go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def manifest(samples: DataFrame) -> DataFrame:
    """The table beside exported samples: sizes instead of texts."""
    sizes = F.aggregate("contexts", F.lit(0), lambda a, c: a + F.length(c))
    return samples.select(
        "id", "doc_type", "question_type", "difficulty", F.length("question").alias("question_length"), F.length("ground_truth").alias("answer_length"),
        F.size("contexts").alias("context_count"), sizes.alias("total_context_length"),
    )


def training_lines(samples: DataFrame, form: str = "both") -> DataFrame:
    """(task, text, labels): samples for entity or relation training, or both, which makes two rows of each."""
    tasks = {"entity": "entities", "relation": "relations"}
    wanted = tasks if form == "both" else {form: tasks[form]}
    each = F.explode(F.array(*[F.struct(F.lit(task).alias("task"), "text", F.to_json(column).alias("labels")) for task, column in wanted.items()]))
    return samples.select(each.alias("x")).select("x.*")


def write_weights(spark: SparkSession, weights: dict[str, dict[str, float]], path: str) -> None:
    """Learned weights of each intent as JSON lines."""
    rows = [(intent, own) for intent, own in sorted(weights.items())]
    spark.createDataFrame(rows, "intent string, weights map<string,double>").coalesce(1).write.mode("overwrite").json(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("intent string, weights map<string,double>").json(path)


def index_docs(chunks: DataFrame) -> DataFrame:
    """Chunks as the keyword index takes them."""
    return chunks.select(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("namespace", F.lit("default")).alias("namespace"))


# ---- benchmark sets: every one becomes (question_id, question, answer, contexts, source) ----------


def _normal(rows: DataFrame, source: str, question: Column, answer: Column, contexts: Column, key: Column) -> DataFrame:
    kept = rows.select(
        F.concat_ws("_", F.lit(source), key.cast("string")).alias("question_id"), question.alias("question"), answer.alias("answer"),
        F.filter(contexts, lambda c: F.coalesce(F.trim(c), F.lit("")) != "").alias("contexts"), F.lit(source).alias("source"),
    )
    return kept.filter((F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != "") & (F.size("contexts") > 0))


def natural_questions(rows: DataFrame) -> DataFrame:
    """Short answer, else yes or no; markup tokens among the first 2000 go."""
    tokens = F.filter(F.slice("tokens", 1, 2000), lambda t: ~F.rlike(t, F.lit("^<.*>$")))
    answer = F.coalesce(F.try_element_at("short_answers", F.lit(1)), F.nullif(F.lower("yes_no"), F.lit("none")))
    return _normal(rows, "nq", F.col("question"), answer, F.array(F.array_join(tokens, " ")), F.col("id"))


def hotpot(rows: DataFrame) -> DataFrame:
    """Supporting sentences by (title, number), else three sentences of the first two paragraphs."""
    picked = F.filter(
        F.transform("facts", lambda f: F.try_element_at(F.try_element_at(F.map_from_entries("paragraphs"), f["title"]), f["sentence"] + 1)), lambda s: s.isNotNull()
    )
    first = F.flatten(F.transform(F.slice("paragraphs", 1, 2), lambda p: F.slice(p["sentences"], 1, 3)))
    return _normal(rows, "hotpot", F.col("question"), F.col("answer"), F.when(F.size(picked) > 0, picked).otherwise(first), F.col("id"))


def marco(rows: DataFrame) -> DataFrame:
    """Selected passages, else the first three; rows without an answer go."""
    chosen = F.transform(F.filter("passages", lambda p: p["is_selected"] == 1), lambda p: p["text"])
    first = F.slice(F.filter(F.transform("passages", lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), 1, 3)
    return _normal(rows, "marco", F.col("query"), F.try_element_at("answers", F.lit(1)), F.when(F.size(chosen) > 0, chosen).otherwise(first), F.col("id"))


def fever(rows: DataFrame) -> DataFrame:
    """Claims with their label."""
    return _normal(rows, "fever", F.col("claim"), F.col("label"), F.array(F.concat(F.lit("Evidence for: "), "claim")), F.col("id"))


def ragbench(rows: DataFrame) -> DataFrame:
    return _normal(rows, "ragbench", F.col("question"), F.col("response"), F.col("documents"), F.col("id"))


def log_questions(rows: DataFrame) -> DataFrame:
    """Questions on logs: the log lines are the context."""
    return _normal(rows, "logqa", F.col("question"), F.col("answer"), F.split("log", "\n"), F.col("id"))
