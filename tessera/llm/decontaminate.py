"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item is a sequence of words; its patterns are its windows of ``width``
consecutive words (all its words where it has fewer). Symbols are whole words, so
an occurrence always begins and ends at word borders. For patterns of one length
``m`` the block of the last two words read decides by the shift table how many
words can be skipped; only where the shift is 0 does the block's bucket give the
patterns that end so, and the words themselves are then compared.

Blocks of patterns are cut to a bounded number of pattern words; each block is one
pass over the documents. With one block nothing is shuffled. With more, every row of
documents is written with a key of its own; the blocks then follow one another - a
block is broadcast, its pass written, its broadcast destroyed - and a row's hits of
all blocks come together by its key.

Edge cases: null or empty text has no words and no hits; an item without words is
no pattern; the windows of an item without id are hits, but no item is named; items
that repeat an id are one item; every row of documents, repeated ones and those without
id too, has a row of its own; columns of other names pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeing, table, without, written

#: Words of a window, and pattern words broadcast at once.
WIDTH, BLOCK_WORDS = 13, 2_000_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Patterns of one length ``m`` (in words) with the items they belong to."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = pattern[end - 2 : end] if self.block == 2 else pattern[end - 1]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            key = pattern[-2:] if self.block == 2 else pattern[-1]
            self.bucket.setdefault(key, []).append((pattern, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Starts of occurrences with their pattern's items."""
        m, n, shift, default, bucket = self.m, len(words), self.shift, self.default, self.bucket
        at = m - 1
        if self.block == 1:
            for at in range(n):
                for _, items in bucket.get(words[at], ()):
                    yield at, items
            return
        get = shift.get
        while at < n:
            key = (words[at - 1], words[at])
            step = get(key, default)
            if step:
                at += step
                continue
            begin = at - m + 1
            found = tuple(words[begin : at + 1])
            for pattern, items in bucket[key]:
                if pattern == found:
                    yield begin, items
            at += 1


def matchers(items: list[tuple], width: int = WIDTH) -> list[WuManber]:
    """One matcher for each pattern length of (item_id, text) rows."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item_id, text in items:
        words = words_of(text)
        m = min(width, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            own = by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), set())
            if item_id is not None:
                own.add(str(item_id))
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())]


def search(text: str | None, found_by: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged hit spans (word numbers, end exclusive) and items of a text."""
    words = words_of(text)
    spans, items = [], set()
    for matcher in found_by:
        for begin, own in matcher.find(words):
            spans.append((begin, begin + matcher.m))
            items |= own
    return len(words), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SCHEMA = "row long, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document with its words, hit spans (in words) and items: the operator's own output."""
    spark = docs.sparkSession
    weigh = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    total = benchmark.agg(F.sum(weigh * width)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    own_row = F.monotonically_increasing_id() if blocks > 1 else F.lit(0).cast("long")
    rows = docs.select(own_row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if blocks > 1:
        rows = written(rows, "rows")  # all passes must see the same keys
    out = None
    for k in range(blocks):
        part = benchmark.select("item_id", "text")
        if blocks > 1:  # a block holds block_words pattern words on average
            part = part.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])

        def run(batches, shared=shared):
            found_by = matchers(shared.value, width)
            for batch in batches:
                found = [search(t, found_by) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("doc_id"),
                        pa.array([r[0] for r in found], pa.int64()),
                        pa.array([[s[0] for s in r[1]] for r in found], pa.list_(pa.int64())),
                        pa.array([[s[1] for s in r[1]] for r in found], pa.list_(pa.int64())),
                        pa.array([sorted(r[2]) for r in found], pa.list_(pa.string())),
                    ],
                    schema=_ARROW,
                )

        own = rows.mapInArrow(freeing(run), _SCHEMA)
        if blocks > 1:
            own = written(own, "block")
            shared.destroy()
        out = own if out is None else out.unionByName(own)
    if blocks == 1:
        return out.drop("row")
    spans = F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))
    joined = out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(spans).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return joined.select(
        "doc_id", "n_words", F.col("spans.begins").alias("begins"), F.col("spans.ends").alias("ends"), "items"
    )


def _n_hit():
    """Words in the union of spans ordered by their begins (blocks of patterns may overlap)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["ends"] - F.greatest(s["begins"], acc["to"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(acc["to"], s["ends"]).alias("to"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.arrays_zip("begins", "ends"), zero, step, lambda acc: acc["n"])


def verdicts(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Contract rows: hit words, items, and whether a twentieth of the words is hit."""
    found = hits(docs, benchmark, width, block_words).withColumn("n_hit", _n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    bad = written(verdicts(docs, benchmark).filter("contaminated").select("doc_id"), "contaminated")
    return without(docs, bad)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> dict:
    """The contract's row of every document, by comparing every window at every place (for tests)."""
    out = {}
    for doc_id, text in docs:
        words = words_of(text)
        hit, own = set(), set()
        for item_id, item in items:
            w = words_of(item)
            m = min(width, len(w))
            if not m:
                continue
            for k in range(len(w) - m + 1):
                for at in range(len(words) - m + 1):
                    if words[at : at + m] == w[k : k + m]:
                        hit.update(range(at, at + m))
                        own |= {str(item_id)} if item_id is not None else set()
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(own), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out
