"""Pronouns and what they stand for, by scored antecedents in a window of sentences, in four languages.

A text is a row of runs of letters and runs of others. Pronouns and entities are found by
patterns; their places are sums over the texts between them inside the row, so that no other
run becomes a row. A pronoun meets the entities that end before it in its own sentence or in
one of the last few, by an equality join on the sentence (an entity is handed on to the
sentences that may look back to it). The best score wins: 10 for a type that the pronoun may
stand for, 2 for each sentence nearer than the farthest one, 5 in the same sentence; the first
entity on ties.

Entities come as a table; what finds them is not part of this module.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pronouns by language, and the types of entities that English ones may stand for (others: all).
PERSON = ("he", "she", "him", "her", "his", "hers", "himself", "herself", "they", "them", "their", "theirs", "themselves")
THING = ("it", "its", "itself")
RELATIVE = ("who", "whom", "whose", "which", "that")
PRONOUNS = {
    "en": (*PERSON, *THING, *RELATIVE),
    "de": ("er", "sie", "ihm", "ihr", "sein", "seine", "ihrer", "dessen", "deren", "es"),
    "fr": ("il", "elle", "lui", "leur", "eux", "elles", "son", "sa", "ses", "leurs", "ce", "ça", "cela", "ceci", "qui", "que", "dont", "lequel", "laquelle", "lesquels", "lesquelles"),
    "es": ("él", "ella", "ellos", "ellas", "le", "les", "lo", "la", "los", "las", "su", "sus", "suyo", "suya", "ello", "esto", "eso", "aquello", "que", "quien", "quienes", "cual", "cuales", "cuyo", "cuya"),
}
PERSONS, ORGANISATIONS = ("PERSON", "PER", "PEOPLE"), ("ORGANIZATION", "ORG", "COMPANY", "GPE", "NORP")
THINGS = ("PRODUCT", "WORK_OF_ART", "EVENT", "LAW", "TECHNOLOGY", "SOFTWARE")
BACK = 3


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sums_before(values: pa.Array) -> pa.Array:
    """For every list the sum of the numbers before each of its own."""
    own, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(values), 0)))
    before = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
    begins = np.concatenate([[0], ends]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(before[:-1] - np.repeat(before[begins[:-1]], np.diff(begins))))


#: Where a run of letters begins and ends. Java looks back by code points only where the pattern holds one beyond the first plane.
BEGIN, END = "(?<![\\p{L}\U00020000])", "(?!\\p{L})"


def runs_of(texts: DataFrame) -> DataFrame:
    """Texts (id, lang, text) as the functions below take them; they find the runs they need in each row."""
    return texts.select("id", "lang", "text")


def _cut(rows: DataFrame, pattern: Column, *others: str) -> DataFrame:
    """(id, lang, text, words, gaps): the words of a ``pattern`` in each text, and what stands before, between and behind them."""
    return rows.select("id", "lang", "text", F.regexp_extract_all("text", pattern, F.lit(0)).alias("words"), F.split("text", pattern, -1).alias("gaps"), *others)


def _each(runs: DataFrame, pattern: Column) -> DataFrame:
    """(id, lang, k, run, start, sentence): a row for each word of a ``pattern`` that is a run: its number, place and sentence.

    A sentence ends with each run of other signs that holds one of ``.!?``.
    """
    cut = _cut(runs, pattern).withColumn("gaps", F.slice("gaps", 1, F.size("words")))
    lengths = F.zip_with("gaps", "words", lambda gap, word: F.length(gap) + F.length(word))
    cut = cut.withColumn("ends", F.transform("gaps", lambda gap: F.regexp_count(gap, F.lit(r"[.!?]\P{L}*"))))
    cut = cut.withColumns({"places": _sums_before(lengths), "before": _sums_before(F.col("ends"))})
    one = lambda x, k: F.struct(k.alias("k"), x.alias("run"), (F.get("places", k) + F.length(F.get("gaps", k))).alias("start"), (F.get("before", k) + F.get("ends", k)).alias("sentence"))
    return cut.select("id", "lang", F.explode(F.transform("words", one)).alias("r")).select("id", "lang", "r.*")


def _places(runs: DataFrame) -> DataFrame:
    """(id, at, sentence) of every run of a text."""
    each = runs.select("id", F.regexp_extract_all("text", F.lit(r"\p{L}+|\P{L}+"), F.lit(0)).alias("runs"))
    ends = F.transform("runs", lambda x: F.rlike(x, F.lit("[.!?]")).cast("int"))
    lists = each.select("id", _sums_before(F.transform("runs", F.length)).alias("at"), _sums_before(ends).alias("sentence"))
    return lists.select("id", F.inline(F.arrays_zip("at", "sentence")))


def capitalised(runs: DataFrame, least: int = 6, type_: str = "PERSON") -> DataFrame:
    """Entities (id, start, end, name, type, sentence) by a plain rule: words with a capital and ``least`` letters or more."""
    named = _each(runs, F.lit(rf"{BEGIN}\p{{Lu}}\p{{Ll}}{{{max(least - 1, 1)},}}+{END}"))
    return named.select("id", "start", (F.col("start") + F.length("run")).alias("end"), F.col("run").alias("name"), F.lit(type_).alias("type"), "sentence")


def _pronoun() -> Column:
    """The pattern of pronouns of a text's language; words that only Unicode's other case rules make equal are among them."""
    own = F.coalesce("lang", F.lit("en"))
    return reduce(lambda out, x: out.when(own == x[0], F.lit(f"{BEGIN}(?iu:{'|'.join(x[1])}){END}")), PRONOUNS.items(), F).otherwise(F.lit("(?!)"))


def antecedents(runs: DataFrame, entities: DataFrame, back: int = BACK) -> DataFrame:
    """(id, k, start, pronoun, antecedent, type, score) of every pronoun that an entity comes before, ``back`` sentences at most.

    Entities (id, start, end, name, type) may come with their ``sentence``; without, runs are looked up by their places.
    """
    known = reduce(or_, [(F.coalesce("lang", F.lit("en")) == lang) & F.lower("run").isin(*words) for lang, words in PRONOUNS.items()])
    pronouns = _each(runs, _pronoun()).filter(known).select("id", "k", "start", "sentence", F.col("run").alias("pronoun"))
    own = entities.select("id", F.col("start").alias("at"), F.col("end").alias("upto"), F.col("name").alias("antecedent"), "type", *(["sentence"] if "sentence" in entities.columns else []))
    if "sentence" not in own.columns:
        own = own.join(_places(runs), ["id", "at"])  # an entity begins where a run does
    own = own.withColumnRenamed("sentence", "said")
    reach = own.withColumn("sentence", F.explode(F.sequence(F.col("said"), F.col("said") + back)))
    met = pronouns.join(reach, ["id", "sentence"]).filter(F.col("upto") < F.col("start"))
    word = F.lower("pronoun")
    wanted = F.when(word.isin(*PERSON), F.col("type").isin(*PERSONS, *ORGANISATIONS)).when(word.isin(*THING), F.col("type").isin(*ORGANISATIONS, *THINGS)).otherwise(F.col("type").isin(*PERSONS, *ORGANISATIONS, *THINGS))
    away = F.col("sentence") - F.col("said")
    score = F.when(wanted, 10).otherwise(0) + (back - away) * 2 + F.when(away == 0, 5).otherwise(0)
    best = F.min(F.struct((-score).alias("o"), "at", "antecedent", "type")).alias("b")
    return met.groupBy("id", "sentence", "k", "start", "pronoun").agg(best).select("id", "k", "start", "pronoun", "b.antecedent", "b.type", (-F.col("b.o")).alias("score"))


def rewritten(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, text, n_resolved): texts with their antecedents in place of pronouns; texts without a run are not there.

    A text meets its pronouns as one list, and is put together from what stands between them in its row.
    """
    listed = F.array_sort(F.collect_list(F.struct("k", "antecedent")))
    hits = found.groupBy("id").agg(listed["k"].alias("at"), listed["antecedent"].alias("names"))
    rows = _cut(runs.filter(F.length("text") > 0).join(hits, "id", "left"), _pronoun(), "at", "names")
    # the words and gaps in turn; behind the i-th resolved pronoun those up to the next one follow as they are
    kept = F.flatten(F.zip_with("gaps", "words", lambda gap, word: F.array(gap, F.coalesce(word, F.lit("")))))
    begin = lambda i: F.coalesce(F.get("at", i) * 2 + 2, F.lit(0))
    piece = lambda i, end: F.slice("kept", begin(i) + 1, F.greatest(end - begin(i), F.lit(0)))
    parts = F.flatten(F.transform("names", lambda name, i: F.array_append(piece(i - 1, F.get("at", i) * 2 + 1), name)))
    rest = piece(F.size("names") - 1, F.size("kept"))
    whole = rows.withColumn("kept", kept).withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "names": F.coalesce("names", F.array().cast("array<string>"))})
    return whole.select("id", F.array_join(F.concat(parts, rest), "").alias("text"), F.size("names").cast("long").alias("n_resolved"))


def chains(found: DataFrame) -> DataFrame:
    """(id, antecedent, type, n, first): the mentions of each entity of a text."""
    return found.groupBy("id", "antecedent", "type").agg(F.count("*").alias("n"), F.min("start").alias("first"))
