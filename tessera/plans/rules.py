"""Rules over questions, answers and tools: each turn asks with a beginning of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as ru
from tessera.functions import vectors
from tessera.plans.registry import query
from tessera.sources.tables import events, load

BEGINNINGS = ("What is the exact value in Table 3 for New York of ", "Explain the main idea: ", "please tell me about ", "ANSWER: graph SCORE: 0.8 ISSUES: [a, b,] ", "")
_ASKS = "(SELECT conv_id, turn, role, ([" + ", ".join(f"'{b}'" for b in BEGINNINGS) + "])[turn % 5 + 1] || text AS q FROM conversations)"


def asks(spark, d):
    begin = F.element_at(F.array(*[F.lit(b) for b in BEGINNINGS]), (F.col("turn") % 5 + 1).cast("int"))
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(begin, "text").alias("q"))


def _q(s):
    return s.replace("'", "''")


def _hits(patterns):
    return "(" + " + ".join(f"regexp_matches(q, '{_q(p)}')::INT" for p in patterns) + ")"


def _any(words, text="lower(q)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query("SELECT DISTINCT p_type, lower(translate(p_type || '_x-y', '_-', '  ')) AS type_text FROM part")
def type_texts(spark, d):
    return load(spark, d, "part").select("p_type", ru.type_text(F.concat("p_type", F.lit("_x-y"))).alias("type_text")).distinct()


@query(f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_slice(regexp_split_to_array(trim(q), '\\s+'), 2, 1000000), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND regexp_matches(w, '\\p{{Ll}}')), ',') AS names FROM {_ASKS}""")
def capitalised_entities(spark, d):
    """Capitalised words of a question but its first."""
    return asks(spark, d).select("conv_id", "turn", F.array_join(ru.capitalised_entities(F.col("q")), ",").alias("names"))


@query(f"""SELECT conv_id, turn, CASE WHEN f >= h THEN 'fine-grained' ELSE 'holistic' END AS granularity, round(CASE WHEN f + h = 0 THEN 0.6 ELSE least(0.9, 0.7 + greatest(f, h) / (f + h)::DOUBLE * 0.2) END, 6)::DOUBLE AS confidence
FROM (SELECT conv_id, turn, {_hits(ru.FINE)} AS f, {_hits(ru.HOLISTIC)} AS h FROM {_ASKS})""")
def question_granularity(spark, d):
    """Whether a factual question asks for a detail or the whole."""
    kind, sure = ru.granularity(F.col("q"))
    return asks(spark, d).select("conv_id", "turn", kind.alias("granularity"), F.round(sure, 6).alias("confidence"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_any(ru.VAGUE, "trim(lower(q))")} AND n <= 5 THEN 'refinement' WHEN role <> 'user' AND n <= 4 THEN 'refinement' WHEN n < 3 THEN 'expansion' WHEN role = 'user' AND n <= 5 THEN 'expansion' ELSE 'none' END AS strategy
FROM (SELECT *, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS n FROM (SELECT conv_id, turn, role, array_to_string(list_slice(string_split(q, ' '), 1, (turn % 7 + 1)::INT), ' ') AS q FROM {_ASKS}))""")
def rewrite_strategies(spark, d):
    """How to rewrite queries of one to seven words; users ask for facts."""
    rows = asks(spark, d).withColumn("q", F.array_join(F.slice(F.split("q", " "), F.lit(1), (F.col("turn") % 7 + 1).cast("int")), " "))
    intent = F.when(F.col("role") == "user", "factual").otherwise("exploratory")
    return rows.select("conv_id", "turn", ru.rewrite_strategy(F.col("q"), intent).alias("strategy"))


@query(f"""SELECT conv_id, turn, CASE WHEN contains(u, 'VECTOR') THEN 'vector' WHEN contains(u, 'GRAPH') THEN 'graph' WHEN contains(u, 'HYBRID') THEN 'hybrid' WHEN contains(u, 'MEMORY') THEN 'memory' WHEN contains(u, 'UNKNOWN') THEN 'unknown' ELSE 'hybrid' END AS intent FROM (SELECT conv_id, turn, upper(q) AS u FROM {_ASKS})""")
def intent_parse(spark, d):
    """The intent named in an answer."""
    return asks(spark, d).select("conv_id", "turn", ru.parsed_intent(F.col("q")).alias("intent"))


_WEB = "trim(lower(q))"
for _p in ru.PHRASES:
    _WEB = f"replace({_WEB}, '{_p}', '')"


@query(f"SELECT conv_id, turn, CASE WHEN contains(w, '2025') OR contains(w, '2024') THEN w ELSE w || ' 2025' END AS web_query FROM (SELECT conv_id, turn, trim({_WEB}) AS w FROM {_ASKS})")
def web_queries(spark, d):
    """Queries for a web search."""
    return asks(spark, d).select("conv_id", "turn", ru.web_query(F.col("q")).alias("web_query"))


@query("""SELECT conv_id, string_agg('[' || k || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) GROUP BY conv_id""")
def context_builder(spark, d):
    """A conversation's turns as numbered contexts."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(ru.numbered(F.transform(rows, lambda r: r["text"])).alias("context"))


_TOPIC = ", ".join(f"CASE WHEN bool_or({_any(words, 'lower(text)')}) THEN ['{t}'] ELSE CAST([] AS VARCHAR[]) END" for t, words in ru.TOPICS.items())


@query(f"SELECT conv_id, array_to_string(list_sort(list_concat({_TOPIC})), ',') AS topics FROM conversations WHERE turn < 3 GROUP BY conv_id")
def conversation_topics(spark, d):
    """Topics of a conversation's first three messages."""
    first = load(spark, d, "conversations").filter("turn < 3").groupBy("conv_id").agg(F.collect_list("text").alias("first"))
    return first.select("conv_id", F.array_join(ru.topics(F.col("first")), ",").alias("topics"))


_BROKEN = "(" + " + ".join(f"regexp_matches(a, '{_q(p)}')::INT" for p in ru.BROKEN) + ")"
_ANSWERS = "(SELECT conv_id, turn, text || (['[1] [2]', '[2]', chr(10) || '## ' || chr(10), '[x]( )', chr(10) || '- '])[turn % 5 + 1] AS a FROM conversations)"


@query(f"""SELECT conv_id, turn, round(greatest(0.0, 1 - 0.1 * ({_BROKEN} + (len(c) > 0 AND (c[len(c)] <> len(c) OR list_contains(c, 0)))::INT)), 6)::DOUBLE AS score FROM (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: x::INT))) AS c FROM {_ANSWERS})""")
def format_compliance(spark, d):
    """How well answers keep to the format."""
    tails = F.element_at(F.array(*[F.lit(x) for x in ("[1] [2]", "[2]", "\n## \n", "[x]( )", "\n- ")]), (F.col("turn") % 5 + 1).cast("int"))
    return load(spark, d, "conversations").select("conv_id", "turn", ru.format_score(F.concat("text", tails)).alias("score"))


@query("""SELECT n_nationkey, replace('{{name}} in {{region}}, {{other}}', '{{name}}', n_name) AS t0, 'name ' || n_name || ', region ' || n_regionkey AS formatted, '{name} {missing}' AS kept, n_name || '; ' || n_nationkey || '; x' AS joined FROM nation""")
def text_tools(spark, d):
    """Template, format and join tools."""
    rows = load(spark, d, "nation")
    return rows.select(
        "n_nationkey",
        ru.template(F.lit("{{name}} in {{region}}, {{other}}"), {"name": F.col("n_name")}).alias("t0"),
        ru.formatted("name {name}, region {region}", {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("formatted"),
        ru.formatted("{name} {missing}", {"name": F.col("n_name")}).alias("kept"),
        F.array_join(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("x")), "; ").alias("joined"),
    )


_LOG = {"lookup": ("what error", "which error", "what exception", "error code", "timestamp", "when did", "log entry", "message"), "howto": ("how to fix", "how to resolve", "troubleshoot", "debug", "solution for", "steps to", "remedy", "workaround")}
_GENERIC = {"definition": ("what is", "define"), "comparison": ("compare", "difference"), "policy": ("explain",)}
_KIND = "CASE " + " ".join(f"WHEN {_any(words)} THEN '{k}'" for k, words in [*_LOG.items(), *_GENERIC.items()]) + " ELSE 'lookup' END"


@query(f"""SELECT conv_id, turn, kind, CASE WHEN kind IN ('multihop', 'policy') THEN CASE WHEN n > 2000 THEN 'D3' ELSE 'D2' END WHEN kind IN ('comparison', 'howto') THEN 'D2' WHEN kind IN ('lookup', 'entity', 'numeric') THEN CASE WHEN n < 1000 THEN 'D1' ELSE 'D2' END WHEN n < 500 THEN 'D1' WHEN n < 2000 THEN 'D2' ELSE 'D3' END AS difficulty
FROM (SELECT conv_id, turn, {_KIND} AS kind, length(q) * 4 AS n FROM {_ASKS})""")
def question_difficulty(spark, d):
    """The type of log questions (their key words first), and the difficulty by type and length."""
    from tessera.functions.text import first_match

    kind = first_match(F.lower("q"), {**_LOG, **_GENERIC}, "lookup")
    rows = asks(spark, d).withColumn("kind", kind)
    return rows.select("conv_id", "turn", "kind", ru.rule_difficulty(F.col("kind"), F.length("q") * 4).alias("difficulty"))


_CAP = f"regexp_extract_all(q, '{ru.CAPITALISED}', 1)"
_LONGEST = f"list_filter({_CAP}, lambda m: length(m) = list_max(list_transform({_CAP}, lambda x: length(x))))[1]"
_PLACE = "instr(q, e)"


@query(f"""WITH x AS (SELECT conv_id, turn, q, coalesce({_LONGEST}, regexp_extract_all(q, '"([^"]+)"', 1)[1]) AS e, {_LONGEST} AS s FROM {_ASKS}),
y AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(q), '{ru.ASKING}', ''), '\\s+'), lambda w: w <> '') AS ws FROM x)
SELECT conv_id, turn, CASE WHEN e IS NOT NULL THEN substr(q, 1, {_PLACE} - 1) || 'Zorb' || substr(q, {_PLACE} + length(e)) ELSE 'Regarding Zorb, ' || lower(q) END AS swapped, coalesce(s, CASE WHEN len(ws) > 0 THEN array_to_string(ws[1:3], ' ') ELSE 'this topic' END) AS subject FROM y""")
def unanswerable_questions(spark, d):
    """Questions about an entity that doesn't exist, and what questions are about."""
    return asks(spark, d).select("conv_id", "turn", ru.swapped_entity(F.col("q"), F.lit("Zorb")).alias("swapped"), ru.subject(F.col("q")).alias("subject"))


@query(f"SELECT conv_id, turn, CASE {' '.join(f'WHEN {_any(w)} THEN {chr(39)}{k}{chr(39)}' for k, w in ru.TASKS.items())} ELSE 'general' END AS context FROM {_ASKS}")
def task_context(spark, d):
    """The context of a task by the first group with a key word in it."""
    from tessera.functions.text import first_match

    return asks(spark, d).select("conv_id", "turn", first_match(F.lower("q"), ru.TASKS, "general").alias("context"))


_TOOLS = {"read": (("view", "click"), ("part",)), "write": (("purchase",), ("standard", "small")), "all": ((), ("e",))}
_CAPS = ", ".join(f"CASE WHEN {('lower(name) IN (' + ', '.join(repr(t) for t in tools) + ') OR ') if tools else ''}{_any(words, 'both_')} THEN ['{c}'] ELSE CAST([] AS VARCHAR[]) END" for c, (tools, words) in _TOOLS.items())


@query(f"SELECT name, description, array_to_string(list_concat({_CAPS}), ',') AS categories FROM (SELECT DISTINCT p_brand AS name, p_type AS description, lower(p_brand) || ' ' || lower(p_type) AS both_ FROM part)")
def tool_capabilities(spark, d):
    """All categories of tools by list or key word."""
    tools = load(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("description")).distinct()
    return tools.withColumn("categories", F.array_join(ru.capabilities(F.col("name"), F.col("description"), _TOOLS), ","))


@query(f"""SELECT conv_id, turn, coalesce(least(1.0, greatest(0.0, try_cast(nullif(regexp_extract(q, 'SCORE:\\s*([0-9.]+)', 1), '') AS DOUBLE))), 0.5)::DOUBLE AS score, array_to_string(list_filter(list_transform(string_split(regexp_extract(q, '(?s)ISSUES:\\s*\\[(.*?)\\]', 1), ','), lambda p: trim(p)), lambda p: p <> ''), '|') AS issues FROM {_ASKS}""")
def critique_parse(spark, d):
    """Score and issues of a critique."""
    return asks(spark, d).select("conv_id", "turn", ru.critique_score(F.col("q")).alias("score"), F.array_join(ru.critique_issues(F.col("q")), "|").alias("issues"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE user_id + event_id END AS total, event_id % 3 AS form FROM events""")
def json_arrays(spark, d):
    """Arrays in answers: plain, in a fence of words, and broken."""
    rows = events(spark, d)
    plain = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", "), F.col("event_id").cast("string"), F.lit("]"))
    k = F.col("event_id") % 3
    text = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```"))).otherwise("[1, oops")
    found = ru.json_array(text, "array<bigint>")
    return rows.select("event_id", F.when(F.size(found) == 2, found[0] + found[1]).alias("total"), k.alias("form"))


@query("""SELECT event_id, to_json({'event_id': event_id, 'event_type': event_type})::VARCHAR AS line, CASE WHEN event_id % 2 = 0 THEN 'missing' ELSE '' END AS missing FROM events""")
def json_tools(spark, d):
    """Rows to JSON, and required fields of parameters."""
    rows = events(spark, d)
    line = F.to_json(F.struct("event_id", "event_type"))
    own = F.when(F.col("event_id") % 2 == 0, F.lit('{"k": 3, "name": "x"}')).otherwise(F.lit('{"k": 3, "name": "x", "missing": true}'))
    return rows.select("event_id", line.alias("line"), F.array_join(ru.missing_fields(own, {"k": "number", "name": "string", "missing": "boolean"}), ",").alias("missing"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, i) AS r FROM e WHERE w > 0)
SELECT vec_id, array_to_string(list(i ORDER BY r), ',') AS idx, round(sum(w), 6) AS total FROM k WHERE r <= 5 GROUP BY vec_id""")
def sparse_vectors(spark, d):
    """Dense to sparse (five heaviest entries) and back to a map."""
    pairs = F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("w")))
    rows = load(spark, d, "embeddings").select("vec_id", F.map_from_entries(pairs).alias("m"))
    rows = rows.select("vec_id", vectors.sparse_top(F.col("m"), 0.0, 5).alias("s")).filter(F.size("s") > 0)
    back = F.map_from_arrays(F.col("s.index"), F.col("s.weight"))
    total = F.aggregate(F.map_values(back), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.array_join(F.transform("s", lambda e: e["index"].cast("string")), ",").alias("idx"), F.round(total, 6).alias("total"))
