"""Text queries: conversations ask, documents and pages are parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.registry import query
from tessera.sources.tables import load

_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s?]', '', 'g'), ' ') AS normal FROM conversations")
def normal_queries(spark, d):
    """Lower case, single spaces, no punctuation but question marks."""
    return load(spark, d, "conversations").select("conv_id", "turn", tx.normal_query(F.col("text")).alias("normal"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name)), '\\s+', '_', 'g'), '[^\\p{L}\\p{N}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS entity_id FROM customer")
def entity_ids(spark, d):
    return load(spark, d, "customer").select("c_custkey", tx.entity_id(F.col("c_name")).alias("entity_id"))


@query("SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS chunk_id FROM (SELECT doc_id, sha256(source || ':' || doc_id || ':' || text) AS h FROM documents)")
def chunk_ids(spark, d):
    """SHA-256 ids in the shape of a UUID."""
    return load(spark, d, "documents").select("doc_id", tx.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, 'doc_' || substr(md5(source || ':' || doc_id), 1, 12) AS document_id, md5(source || ':' || doc_id) AS point_id, sha256(lang) || sha256(text) AS cache_key FROM documents")
def id_functions(spark, d):
    """Document, point and cache keys."""
    pair = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return load(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.substring(F.md5(pair), 1, 12)).alias("document_id"), F.md5(pair).alias("point_id"), F.concat(F.sha2("lang", 256), F.sha2("text", 256)).alias("cache_key"))


@query("""WITH c AS (SELECT doc_id, lang, (contains(text, ' der ')::INT + contains(text, ' die ')::INT + contains(text, ' und ')::INT + contains(text, ' ein')::INT) AS de, (contains(text, ' the ')::INT + contains(text, ' of ')::INT + contains(text, ' to ')::INT + contains(text, ' in ')::INT) AS en,
(contains(text, ' le ')::INT + contains(text, ' la ')::INT + contains(text, ' et ')::INT + contains(text, ' de ')::INT) AS fr FROM documents)
SELECT doc_id, CASE WHEN greatest(de, en, fr) < 3 THEN 'en' WHEN de >= en AND de >= fr THEN 'de' WHEN en >= fr THEN 'en' ELSE 'fr' END AS detected FROM c""")
def language_indicators(spark, d):
    """Indicator words counted; fewer than three mean the default."""
    count = lambda *parts: sum((F.col("text").contains(p).cast("int") for p in parts), F.lit(0))
    de, en, fr = count(" der ", " die ", " und ", " ein"), count(" the ", " of ", " to ", " in "), count(" le ", " la ", " et ", " de ")
    best = F.when(F.greatest(de, en, fr) < 3, "en").when((de >= en) & (de >= fr), "de").when(en >= fr, "en").otherwise("fr")
    return load(spark, d, "documents").select("doc_id", best.alias("detected"))


@query(f"""SELECT conv_id, turn, score, CASE WHEN score < 0.3 THEN 'fast' WHEN score < 0.6 THEN 'balanced' ELSE 'advanced' END AS tier FROM (
SELECT conv_id, turn, round(least(n / 30.0::DOUBLE, 1) * 0.3 + least(e / 5.0::DOUBLE, 1) * 0.3 + CASE WHEN contains(text, '?') THEN 0.2 ELSE 0.0 END, 6) AS score FROM (
SELECT conv_id, turn, text, len({_WORDS}) AS n, len(list_filter(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 2, 1000000), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT regexp_matches(w, '^\\p{{Lu}}+$'))) AS e FROM conversations))""")
def query_complexity(spark, d):
    """Words, capitalised words after the first, and a question mark, weighted into tiers."""
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    names = F.filter(F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))), lambda w: F.rlike(w, F.lit(r"^\p{Lu}")) & ~F.rlike(w, F.lit(r"^\p{Lu}+$")))
    score = F.least(F.size(ws) / 30.0, F.lit(1.0)) * 0.3 + F.least(F.size(names) / 5.0, F.lit(1.0)) * 0.3 + F.when(F.col("text").contains("?"), 0.2).otherwise(0.0)
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.round(score, 6).alias("score"))
    return rows.withColumn("tier", F.when(F.col("score") < 0.3, "fast").when(F.col("score") < 0.6, "balanced").otherwise("advanced"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(wh|when|last|earlier)') THEN 'episodic' WHEN regexp_matches(lower(text), '(what|who|is)') THEN 'factual' ELSE 'all' END AS layer,
regexp_matches(lower(text), '(recent|just|now)') AS recent, regexp_matches(lower(text), '(yesterday|ago|before|on)') AS temporal FROM conversations""")
def route_layers(spark, d):
    """Memory layers by regex rules, first rule wins."""
    low = F.lower("text")
    has = lambda p: F.rlike(low, F.lit(p))
    layer = F.when(has("(wh|when|last|earlier)"), "episodic").when(has("(what|who|is)"), "factual").otherwise("all")
    return load(spark, d, "conversations").select("conv_id", "turn", layer.alias("layer"), has("(recent|just|now)").alias("recent"), has("(yesterday|ago|before|on)").alias("temporal"))


@query(f"""SELECT conv_id, turn, array_to_string(list_slice(list_filter({_WORDS}, lambda w: length(w) > 3 AND w NOT IN ('this', 'that', 'with', 'from')), 1, 5), ',') AS tags FROM conversations""")
def tag_extraction(spark, d):
    """The first five words of four letters or more that are no stop words."""
    tags = F.filter(tx.words(F.col("text")), lambda w: (F.length(w) > 3) & ~w.isin("this", "that", "with", "from"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.slice(tags, 1, 5), ",").alias("tags"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def conversation_concat(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


@query("""SELECT conv_id, coalesce(left(arg_min(text, turn) FILTER (role = 'user'), 100), '') AS summary, count(*) AS n FROM conversations GROUP BY conv_id""")
def conversation_summary(spark, d):
    """The first user message and the number of turns."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.substring(first, 1, 100), F.lit("")).alias("summary"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'error') THEN 'log' WHEN contains(lower(text), 'wh') THEN 'question' WHEN contains(lower(text), 'th') THEN 'statement' ELSE 'other' END AS kind FROM conversations""")
def question_type(spark, d):
    """The first group of key words contained."""
    kind = tx.first_match(F.lower("text"), {"log": ("error",), "question": ("wh",), "statement": ("th",)}, "other")
    return load(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query("""SELECT doc_id, left(text, 100) || ' ... ' || substr(text, length(text) // 2 - 50, 100) || ' ... ' || right(text, 100) AS sampled FROM documents WHERE length(text) > 600""")
def document_sampling(spark, d):
    """Beginning, middle and end of long texts."""
    rows = load(spark, d, "documents").filter(F.length("text") > 600)
    middle = F.substring("text", F.floor(F.length("text") / 2).cast("int") - 50, F.lit(100))
    return rows.select("doc_id", F.concat_ws(" ... ", F.substring("text", 1, 100), middle, F.right("text", F.lit(100))).alias("sampled"))


@query("""SELECT doc_id, w AS window_no, substr(text, w * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) - 100 + 399) // 400)::BIGINT)) AS w FROM documents)""")
def char_chunks(spark, d):
    """Chunks of 500 characters, a hundred of them shared with the next one."""
    n = F.greatest(F.lit(1), F.floor((F.length("text") - 100 + 399) / 400))
    rows = load(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("window_no"))
    return rows.select("doc_id", "window_no", F.substring("text", (F.col("window_no") * 400 + 1).cast("int"), F.lit(500)).alias("chunk"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: x <> '') AS ss FROM documents),
w AS (SELECT doc_id, ss, unnest(CASE WHEN len(ss) <= 3 THEN [0] ELSE list_distinct(list_concat(range(0, len(ss) - 2, 2), [len(ss) - 3])) END)::BIGINT AS begins FROM s)
SELECT doc_id, begins, array_to_string(list_slice(ss, begins + 1, begins + 3), '. ') AS window_text FROM w""")
def sentence_windows(spark, d):
    """Three sentences, two forward each time, the last three always."""
    ss = F.filter(F.split("text", r"\. "), lambda x: x != "")
    rows = load(spark, d, "documents").select("doc_id", ss.alias("ss"))
    n = F.size("ss")
    starts = F.when(n <= 3, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), n - 3, F.lit(2)), F.array(n - 3))))
    rows = rows.select("doc_id", "ss", F.explode(starts).alias("b"))
    return rows.select("doc_id", F.col("b").cast("long").alias("begins"), F.array_join(F.slice("ss", F.col("b") + 1, F.lit(3)), ". ").alias("window_text"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS heading FROM pages)
SELECT page_id, level::BIGINT AS level, trim(regexp_replace(heading, '<[^>]*>', '', 'g'), ' ') AS heading FROM h""")
def html_sections(spark, d):
    """Headings of pages with their level."""
    pattern = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("heading"))
    rows = load(spark, d, "pages").select("page_id", F.explode(found).alias("s"))
    return rows.select("page_id", F.col("s.level").cast("long").alias("level"), F.trim(F.regexp_replace("s.heading", "<[^>]*>", "")).alias("heading"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), ' ') AS body FROM pages""")
def html_text(spark, d):
    """Pages without scripts, styles and tags, named entities resolved."""
    out = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return load(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(out, r"\s+", " ")).alias("body"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, line, t, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM l WHERE contains(t, ' | '))
SELECT doc_id, min(line)::BIGINT AS first_line, count(*) AS n_rows, max(len(string_split(t, ' | ')))::BIGINT AS n_cols FROM p GROUP BY doc_id, grp""")
def markdown_tables(spark, d):
    """Runs of piped lines are tables: gaps and islands."""
    from pyspark.sql import Window

    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter(F.col("t").contains(" | "))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    rows = lines.withColumn("g", island).groupBy("doc_id", "g").agg(F.min("line").alias("a"), F.count("*").alias("n_rows"), F.max(F.size(F.split("t", r" \| "))).alias("c"))
    return rows.select("doc_id", (F.col("a") + 1).cast("long").alias("first_line"), "n_rows", F.col("c").cast("long").alias("n_cols"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_path(spark, d):
    rows = load(spark, d, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 77) || '...' END AS short, length(text) > 80 AS was_cut, (length(text) // 4)::BIGINT AS tokens, replace(text, 'the', 'THE') AS replaced, len(string_split(text, ' '))::BIGINT AS n_parts FROM documents""")
def string_tools(spark, d):
    """Truncate with a flag, estimate tokens, replace, split."""
    cut = F.length("text") > 80
    return load(spark, d, "documents").select(
        "doc_id", F.when(cut, F.concat(F.substring("text", 1, 77), F.lit("..."))).otherwise(F.col("text")).alias("short"), cut.alias("was_cut"),
        F.floor(F.length("text") / 4).cast("long").alias("tokens"), F.replace("text", F.lit("the"), F.lit("THE")).alias("replaced"), F.size(F.split("text", " ")).cast("long").alias("n_parts"),
    )


@query("""WITH s AS (SELECT conv_id, turn, len(string_split(text, '.'))::BIGINT AS sentences, len(regexp_extract_all(text, '\\[(\\d+)\\]'))::BIGINT AS citations FROM conversations)
SELECT conv_id, turn, sentences, citations, round(least(1.0, citations / sentences::DOUBLE), 6) AS coverage FROM s""")
def citation_coverage(spark, d):
    n, c = F.size(F.split("text", r"\.")).cast("long"), F.size(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(0))).cast("long")
    rows = load(spark, d, "conversations").select("conv_id", "turn", n.alias("sentences"), c.alias("citations"))
    return rows.withColumn("coverage", F.round(F.least(F.lit(1.0), F.col("citations") / F.col("sentences")), 6))


@query("""SELECT p_partkey, levenshtein(p_name, 'red widget') AS distance FROM part""")
def levenshtein_distance(spark, d):
    return load(spark, d, "part").select("p_partkey", F.levenshtein(F.col("p_name"), F.lit("red widget")).cast("long").alias("distance"))


@query("""SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text, '(\\d+)', 1) AS DOUBLE), -1) AS first_number, coalesce(least(1.0, greatest(0.0, TRY_CAST(nullif(regexp_extract(text, '(\\d)', 1), '') AS DOUBLE) / 10)), 0.5) AS score FROM documents""")
def number_parse(spark, d):
    """The first number of a text, and a score of one digit clamped to 0..1 (default a half)."""
    one = F.expr("try_cast(nullif(regexp_extract(text, '([0-9])', 1), '') AS double)") / 10
    every = F.expr("try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS double)")
    return load(spark, d, "documents").select("doc_id", F.coalesce(every, F.lit(-1.0)).alias("first_number"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), one)), F.lit(0.5)).alias("score"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch BETWEEN 'a' AND 'z' GROUP BY ALL)
SELECT doc_id, round(26 * sum(n * (n - 1)) / (sum(n) * (sum(n) - 1))::DOUBLE, 6) AS ic FROM n GROUP BY doc_id HAVING sum(n) > 1""")
def index_of_coincidence(spark, d):
    """26 * sum c (c - 1) / (L (L - 1)) over the letters a to z."""
    counts = F.array(*[(F.length("low") - F.length(F.replace(F.col("low"), F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)])
    rows = load(spark, d, "documents").select("doc_id", F.lower("text").alias("low")).select("doc_id", counts.alias("n"))
    total, pairs = F.aggregate("n", F.lit(0.0), lambda s, x: s + x), F.aggregate("n", F.lit(0.0), lambda s, x: s + x * (x - 1))
    return rows.select("doc_id", total.alias("t"), pairs.alias("p")).filter("t > 1").select("doc_id", F.round(26 * F.col("p") / (F.col("t") * (F.col("t") - 1)), 6).alias("ic"))
