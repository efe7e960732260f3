"""Personal data families, redaction, consent, audit chains, erasure and export."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import luhn_valid

#: Patterns of each family, as the categories' detector has them (fixed values).
FAMILIES = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",),
    "phone": (r"\+?[1-9]\d{1,14}", r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{4}"),
    "postal": (r"\b\d{5}(?:-\d{4})?\b", r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b", r"\b\d{5}\b"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b",),
    "tax": (r"\b\d{2}-\d{7}\b", r"\b\d{2}/\d{3}/\d{5}\b"),
    "national": (r"\b[A-Z]{2}\d{6,9}\b", r"\b\d{9,12}\b"),
    "card": (r"\b(?:\d{4}[-\s]?){3}\d{4,7}\b",),
    "iban": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",),
    "ipv4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b",),
    "ipv6": (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",),
}
#: Families of each category, and the order in which families are redacted: the narrow ones first.
CATEGORIES = {"contact": ("email", "phone", "postal"), "identifier": ("ssn", "tax", "national"), "financial": ("card", "iban"), "location": ("ipv4", "ipv6")}
ORDER = ("email", "ssn", "tax", "card", "iban", "ipv6", "ipv4", "national", "postal", "phone")


def _matches(text: Column, *families: str) -> Column:
    every = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for family in families for pattern in FAMILIES[family]]
    return F.array_sort(F.array_distinct(F.concat(*every)))


def detected(text: Column, family: str) -> Column:
    """Sorted distinct matches of a family; cards must be digits without their signs and pass the mod-10 check."""
    found = _matches(text, family)
    if family == "card":
        digits = lambda m: F.regexp_replace(m, "[ -]", "")
        found = F.filter(found, lambda m: digits(m).rlike("^[0-9]+$") & luhn_valid(digits(m)))
    return found


def category(text: Column, name: str) -> Column:
    """Sorted distinct matches of all patterns of a category, without further checks."""
    return _matches(text, *CATEGORIES[name])


def redacted(text: Column, families: tuple[str, ...] = ("email", "ssn", "tax", "card", "iban", "ipv6", "ipv4")) -> Column:
    """Each family's matches replaced by its name, in order."""
    for family in ORDER:
        for pattern in FAMILIES[family] if family in families else ():
            text = F.regexp_replace(text, pattern, f"[{family.upper()}]")
    return text


def chained(events: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """Each event with its predecessor's hash and its own: SHA-256 of payload and that hash; the first has an empty one.

    A chain can only be written in order: a key's rows are sorted in one partition and
    pass in batches, of which only the last hash is kept.
    """
    rows = events.withColumn("_payload", payload).repartition(key).sortWithinPartitions(key, *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(batches):
        last = before = None
        for batch in batches:
            prevs, hashes = [], []
            for own, text in zip(batch.column(key).to_pylist(), batch.column("_payload").to_pylist()):
                before = before if own == last and before is not None else ""
                last = own
                prevs.append(before)
                before = hashlib.sha256(((text or "") + before).encode()).hexdigest()
                hashes.append(before)
            kept = batch.select([c for c in batch.schema.names if c != "_payload"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*kept.schema.names, "prev", "hash"])

    return rows.mapInArrow(run, f"{kinds}, prev string, hash string")


def breaks(chain: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """Rows of a kept chain that break it: the hash isn't that of payload and predecessor, or the predecessor's isn't the one named."""
    w = Window.partitionBy(key).orderBy(*order)
    again = F.sha2(F.concat(F.coalesce(payload, F.lit("")), "prev"), 256)
    marked = chain.withColumn("_bad_hash", again != F.col("hash")).withColumn("_bad_link", F.col("prev") != F.coalesce(F.lag("hash").over(w), F.lit("")))
    return marked.filter("_bad_hash OR _bad_link").select(*chain.columns, F.when(F.col("_bad_hash"), "hash").otherwise("link").alias("why"))


def new_only(log: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of a batch to append to a log: ids that it does not hold, each once (the first by all columns)."""
    fresh = batch.join(log.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy(*[c for c in batch.columns if c != key])
    return fresh.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*batch.columns)


def erase(rows: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Rows of no erased subject."""
    return rows.join(subjects.select(key).distinct(), key, "left_anti")


def export(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A subject's rows as JSON with a checksum."""
    line = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(key).agg(gathered.alias("payload")).withColumn("checksum", F.sha2("payload", 256))
