"""Rules over queries, answers and tool texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of fine-grained and of holistic questions (fixed values).
FINE = (
    r"(?i)\b(what|which) (is|are) the\b", r"(?i)\b(p-value|score|metric|number|count|percentage)\b", r"(?i)\bTable \d+\b", r"(?i)\bFigure \d+\b",
    r"(?i)\bEquation \d+\b", r"(?i)\b(formula|equation|definition) (for|of)\b", r"(?i)\b(exact|specific|precise) (value|number)\b",
    r"\b[A-Z]{2,}-[A-Z]\d+\b", r"\b\d+(\.\d+)?%\b", r"(?i)\bin (Table|Figure|Section|Chapter|Appendix)\b",
)
HOLISTIC = (
    r"(?i)\b(summarize|overview|describe)\b", r"(?i)\b(main|key|primary) (idea|finding|result)\b", r"(?i)\b(explain|elaborate|detail)\b",
    r"(?i)\b(overall|general|broad)\b", r"(?i)\b(why|reason|rationale|motivation)\b",
)
#: Words of vague questions, phrases deleted from web queries, intents in order (fixed values).
VAGUE = ("how", "what", "explain", "tell me about", "describe", "wie", "was", "erkläre")
PHRASES = ("tell me about", "what is", "what are", "how does", "explain", "can you", "please")
INTENTS = ("VECTOR", "GRAPH", "HYBRID", "MEMORY", "UNKNOWN")
#: Topics of a conversation by key words, contexts of a task by key words (fixed values).
TOPICS = {"RAG Systems": ("rag", "retrieval"), "Graph Databases": ("graph", "neo4j"), "Vector Search": ("vector", "embedding"), "Language Models": ("llm", "ollama")}
TASKS = {
    "search": ("search", "find", "grep", "query", "lookup"),
    "file_ops": ("read", "write", "file", "edit", "create", "save"),
    "execute": ("run", "execute", "exec", "command", "shell"),
    "network": ("http", "request", "fetch", "api", "download"),
    "data": ("parse", "extract", "transform", "convert"),
}
#: Marks of broken Markdown (fixed values).
BROKEN = (r"(?m)^\s*#+\s*$", r"(?m)^\s*[-*+]\s*$", r"\[([^\]]*)\]\(\s*\)", r"(?m)```\s*$")
#: A run of capitalised words; question words at the beginning (fixed values).
CAPITALISED = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
ASKING = r"^(what|when|where|who|which|how|why|is|are|was|were|do|does|did)\s+"


def _hits(text: Column, patterns) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(p).cast("int")
    return out


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def type_text(kind: Column) -> Column:
    """A relation type as words: ``_`` and ``-`` to spaces, lower case."""
    return F.lower(F.translate(kind, "_-", "  "))


def capitalised_entities(text: Column) -> Column:
    """Words after the first that begin with a capital and aren't all capitals, without marks."""
    words = F.slice(F.split(F.trim(text), r"\s+"), F.lit(2), F.lit(1 << 30))
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.filter(clean, lambda w: w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}"))


def granularity(text: Column) -> tuple[Column, Column]:
    """Fine-grained or holistic, and the confidence: 0.6 without a pattern, else 0.7 + 0.2 x share, 0.9 at most."""
    fine, holistic = _hits(text, FINE), _hits(text, HOLISTIC)
    top, total = F.greatest(fine, holistic), fine + holistic
    kind = F.when(fine >= holistic, "fine-grained").otherwise("holistic")
    return kind, F.when(total == 0, 0.6).otherwise(F.least(F.lit(0.9), 0.7 + top / total * 0.2))


def rewrite_strategy(text: Column, intent: Column) -> Column:
    """Refinement of vague and of short exploratory queries, expansion of short and factual ones."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (
        F.when(_any(F.trim(F.lower(text)), VAGUE) & (n <= 5), "refinement")
        .when((intent == "exploratory") & (n <= 4), "refinement")
        .when(n < 3, "expansion")
        .when((intent == "factual") & (n <= 5), "expansion")
        .otherwise("none")
    )


def parsed_intent(answer: Column, default: str = "hybrid") -> Column:
    """The first intent named in an answer, else the one behind a label, else the default."""
    upper = F.upper(F.trim(answer))
    named = F.lower(F.regexp_extract(upper, r"(?:INTENT|CLASSIFICATION|ANSWER):\s*(\w+)", 1))
    out = F.when(named.isin(*[i.lower() for i in INTENTS]), named).otherwise(default)
    for intent in reversed(INTENTS):
        out = F.when(upper.contains(intent), intent.lower()).otherwise(out)
    return out


def web_query(text: Column, year: str = "2025", before: str = "2024") -> Column:
    """Lower case without conversational phrases; the year is added where no recent one is named."""
    out = F.trim(F.lower(text))
    for phrase in PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = F.trim(out)
    return F.when(out.contains(year) | out.contains(before), out).otherwise(F.concat(out, F.lit(f" {year}")))


def numbered(contexts: Column) -> Column:
    """Contexts with their numbers, a blank line between."""
    return F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")


def topics(first: Column) -> Column:
    """Distinct topics of the first messages (an array of texts), sorted."""
    out = F.array().cast("array<string>")
    for topic, words in TOPICS.items():
        named = F.exists(F.transform(first, lambda t: _any(F.lower(t), words)), lambda x: x)  # noqa: B023
        out = F.concat(out, F.when(named, F.array(F.lit(topic))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(out)


def format_score(answer: Column) -> Column:
    """1 less a tenth for each kind of broken Markdown, and for citations that aren't 1, 2, 3, ..."""
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    gaps = (F.size(cited) > 0) & (F.element_at(F.concat(cited, F.array(F.lit(0))), F.greatest(F.size(cited), F.lit(1))) != F.size(cited))
    wrong = gaps | ((F.size(cited) > 0) & F.array_contains(cited, 0))
    return F.round(F.greatest(F.lit(0.0), 1 - 0.1 * (_hits(answer, BROKEN) + wrong.cast("int"))), 6)


def template(text: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by its value; other names stay."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), value.cast("string"))
    return text


def formatted(text: str, values: dict[str, Column]) -> Column:
    """``{name}`` fields replaced; a text that names a missing field comes back as it is."""
    import re

    if set(re.findall(r"\{(\w+)\}", text)) - set(values):
        return F.lit(text)
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def rule_difficulty(kind: Column, size: Column) -> Column:
    """D1 to D3 by the type of question and the contexts' length."""
    return (
        F.when(kind.isin("multihop", "policy"), F.when(size > 2000, "D3").otherwise("D2"))
        .when(kind.isin("comparison", "howto"), "D2")
        .when(kind.isin("lookup", "entity", "numeric"), F.when(size < 1000, "D1").otherwise("D2"))
        .when(size < 500, "D1")
        .when(size < 2000, "D2")
        .otherwise("D3")
    )


def longest(matches: Column) -> Column:
    """The longest of an array of texts, the first of equals; null where there is none."""
    ranked = F.array_sort(F.transform(matches, lambda m, i: F.struct((-F.length(m)).alias("o"), i.alias("i"), m.alias("m"))))
    return F.when(F.size(ranked) > 0, F.get(ranked, F.lit(0))["m"])


def replace_first(text: Column, part: Column, new: Column) -> Column:
    at = F.call_function("locate", part, text)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(part), F.length(text)))


def swapped_entity(question: Column, fake: Column) -> Column:
    """The main entity of a question replaced: the longest capitalised run, else a quoted one, else named in front."""
    entity = longest(F.regexp_extract_all(question, F.lit(CAPITALISED), F.lit(1)))
    quoted = F.get(F.regexp_extract_all(question, F.lit('"([^"]+)"'), F.lit(1)), F.lit(0))
    part = F.coalesce(entity, quoted)
    return F.when(part.isNotNull(), replace_first(question, part, fake)).otherwise(F.concat(F.lit("Regarding "), fake, F.lit(", "), F.lower(question)))


def subject(question: Column) -> Column:
    """What a question is about: the longest capitalised run, else its first three words behind the question word."""
    words = F.filter(F.split(F.regexp_replace(F.lower(question), ASKING, ""), r"\s+"), lambda w: w != "")
    first = F.array_join(F.slice(words, 1, 3), " ")
    return F.coalesce(longest(F.regexp_extract_all(question, F.lit(CAPITALISED), F.lit(1))), F.when(F.size(words) > 0, first).otherwise("this topic"))


def capabilities(name: Column, description: Column, categories: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> Column:
    """All categories that list a tool or have a key word in its name or description, in order."""
    low, out = F.lower(name), F.array().cast("array<string>")
    both = F.concat_ws(" ", low, F.lower(description))
    for category, (tools, words) in categories.items():
        fits = low.isin(*tools) | _any(both, words)
        out = F.concat(out, F.when(fits, F.array(F.lit(category))).otherwise(F.array().cast("array<string>")))
    return out


def critique_score(text: Column) -> Column:
    """The number behind ``SCORE:``, clamped to [0, 1]; a half without one."""
    found = F.regexp_extract(text, r"SCORE:\s*([0-9.]+)", 1)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), found.try_cast("double"))), F.lit(0.5))


def critique_issues(text: Column) -> Column:
    """The parts of the list behind ``ISSUES:``."""
    parts = F.split(F.regexp_extract(text, r"(?s)ISSUES:\s*\[(.*?)\]", 1), ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def json_array(text: Column, kind: str) -> Column:
    """A JSON array of a text: the whole, else the part between the first ``[`` and the last ``]``; null if neither parses."""
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(text, kind), F.from_json(inner, kind))


def missing_fields(parameters: Column, required: dict[str, str]) -> Column:
    """Names of required fields that a JSON object lacks or holds in another type (string, number, boolean)."""
    out = F.array().cast("array<string>")
    shapes = {"string": r'^"', "number": r"^-?[0-9]", "boolean": r"^(true|false)$"}
    fields = F.from_json(parameters, "map<string,string>", {"allowUnquotedFieldNames": "false"})
    for name, kind in required.items():
        value = F.element_at(fields, name)
        plain = {"string": value.isNotNull(), "number": value.rlike(shapes["number"]), "boolean": value.rlike(shapes["boolean"])}[kind]
        out = F.concat(out, F.when(F.coalesce(plain, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(name))))
    return out
