"""Text functions as Column expressions: tokens, normal forms, rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small stop-word list of the keyword search (fixed values, several languages).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with", "der", "die", "das", "und", "in", "zu", "den", "von", "ist", "le", "la", "les", "de",
    "des", "et", "un", "une", "que", "el", "los", "las", "y", "del",
)


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words between white space, punctuation kept, stop words dropped."""
    words = F.split(F.lower(text), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def normal_query(text: Column) -> Column:
    """Lower case, single spaces, only letters, digits, ``_``, spaces and ``?``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^\p{L}\p{N}_\s?]", ""))


def entity_id(name: Column) -> Column:
    """Lower case, white space to ``_``, other signs dropped, single ``_``, none at the ends."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")
    low = F.regexp_replace(low, r"[^\p{L}\p{N}_]", "")
    return F.regexp_replace(F.regexp_replace(low, "_+", "_"), "^_|_$", "")


def relation_type(kind: Column, synonyms: dict[str, str]) -> Column:
    """Upper case, spaces and dashes to ``_``, synonyms to their canonical type."""
    name = F.translate(F.upper(F.trim(kind)), " -", "__")
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(F.element_at(table, name), name)


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def first_match(text: Column, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first group of which a word is contained in the text."""
    out = F.lit(default)
    for name in reversed(groups):
        out = F.when(contains_any(text, groups[name]), F.lit(name)).otherwise(out)
    return out


def shaped_id(digest: Column) -> Column:
    """32 hexadecimal digits in groups of 8-4-4-4-12."""
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cut])


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    """SHA-256 of ``document:index:content``, shaped."""
    return shaped_id(F.sha2(F.concat_ws(":", document, index.cast("string"), content), 256))


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    doubled = F.transform(places, lambda n, k: F.when(k % 2 == 0, n).otherwise(2 * n - 9 * (n > 4).cast("int")))
    return F.aggregate(F.filter(doubled, lambda n: n.isNotNull()), F.lit(0), lambda s, n: s + n) % 10 == 0
