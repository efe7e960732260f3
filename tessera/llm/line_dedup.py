"""Repeated lines by levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z lowered. Keys of
``LEAST_CHARS`` code points that ``LEAST_DOCS`` documents hold lose their lines
everywhere but in the document of the largest id among them.

1. Every long line becomes (doc_id, text hash, place, 128-bit key hash) in one table,
   cut into batches of falling doc_id. A document counts once for a key: its hashes are
   sorted, and the first of equal ones is marked.
2. ``Runs`` is the index. A run is a table of (key hash, documents, largest doc_id),
   bucketed and sorted by key hash, so that joins with it need no exchange of its rows.
   A new batch is pre-aggregated by key, merge-anti-joined with every run (a key that a
   run knows from enough documents, with a larger doc_id, has nothing to learn), and
   what is left becomes a run of level 0. ``FANOUT`` runs of a level are merged to one
   of the next level, whose sources are removed. Batches may come in any order; in
   falling order of doc_id a common line is left out from its second batch on.
3. The runs' sums name the keys that go. They meet the line table by key hash, which
   gives the places that a document loses; the text is read once more for the rest.

Edge cases: null text is one empty line; texts and lines are read whole; every row is a
document, repeated rows and rows without id too. A null id is smaller than all others:
of a key that only rows without id hold, no line goes. Rows that share the largest id
all keep their lines. An empty table gives no rows; columns of other names are not read.
Keys are compared by two 64-bit hashes of the whole key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import consumed, removed, shared_dir, small, table, written

#: Least code points of a key, least documents that hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a whole table is added in, runs of a level that are merged to one of the next.
BATCHES, FANOUT = 6, 3

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(key: Column) -> Column:
    """A-Z lowered; ``lower`` does that alone where all characters are ASCII."""
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def line_table(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, t, pos, a, b, first) of every line with a long key: text hash, place, key hash, first of its document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stripped = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.btrim(line, F.lit(_BLANK)).alias("k"), i.alias("pos")))
    long = F.filter(stripped, lambda x: F.length(x["k"]) >= least_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.transform(long, lambda x: F.struct(_lowered(x["k"]).alias("k"), x["pos"].alias("pos"))).alias("m"))
    hashed = F.transform("m", lambda x: F.struct(F.xxhash64(x["k"]).alias("a"), F.xxhash64(F.lit(1), x["k"]).alias("b"), x["pos"].alias("pos")))
    rows = rows.filter(F.size("m") > 0).select("doc_id", "t", F.array_sort(hashed).alias("m"))
    before = lambda i: F.get("m", i - 1)
    first = lambda x, i: (i == 0) | (before(i)["a"] != x["a"]) | (before(i)["b"] != x["b"])
    marked = F.transform("m", lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["pos"].alias("pos"), first(x, i).alias("first")))
    return rows.select("doc_id", "t", F.explode(marked).alias("x")).select("doc_id", "t", "x.*")


def keys_of(lines: DataFrame) -> DataFrame:
    """(a, b, n, last): documents and largest doc_id of each key of a line table."""
    return lines.filter("first").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


@dataclass
class Runs:
    """Levelled runs of keys in the shared folder; ``levels[k]`` holds the tables of level k."""

    spark: SparkSession
    buckets: int
    least_docs: int = LEAST_DOCS
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, keys: DataFrame) -> str:
        """A run of keys that are dealt by (a, b) already: one file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        keys.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path).saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        removed(self.spark, f"{shared_dir(self.spark)}/{name}")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch's keys (a, b, n, last), less those that a run has settled already."""
        for name in self.names():
            known = self.spark.table(name).filter(F.col("n") >= self.least_docs).select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("last").alias("held"))
            batch = batch.join(known, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (F.col("held") >= F.col("last")), "left_anti")
        self._put(0, self._write(batch))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(full))
            for n in full:
                self._remove(n)
            self._put(level + 1, merged)

    def _merged(self, names: list[str]) -> DataFrame:
        # read as files: Spark 4.1 plans a union of bucketed tables as bucketed, and then may not read it so
        paths = [f"{shared_dir(self.spark)}/{name}" for name in names]
        every = self.spark.read.schema("a long, b long, n long, last long").parquet(*paths)
        return every.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def frequent(self) -> DataFrame:
        """(a, b, last) of the keys that enough documents hold; an index without a run has none."""
        if not self.names():
            return self.spark.createDataFrame([], "a long, b long, last long")
        return self._merged(self.names()).filter(F.col("n") >= self.least_docs).select("a", "b", "last")

    def clear(self) -> None:
        for name in self.names():
            self._remove(name)
        self.levels = []


def _falling(docs: DataFrame, batches: int) -> Column:
    """The batch of a row: 0 has the largest ids, the last one the rows without id too."""
    ids = docs.select(F.col("doc_id").cast("long").alias("d"))
    cuts = ids.agg(F.percentile_approx("d", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    behind = [F.when(F.col("doc_id") < cut, 1).otherwise(0) for cut in sorted(set(cuts or []))]
    return F.when(F.col("doc_id").isNull(), len(behind)).otherwise(sum(behind, F.lit(0))).cast("int")


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, t, at): the places of the lines that documents lose, by id and text hash."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = line_table(docs, least_chars).withColumn("batch", _falling(docs, batches))
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), least_docs, fanout)
    for k in range(batches):
        runs.add(keys_of(lines.filter(F.col("batch") == k)))
    frequent = written(runs.frequent(), "frequent")
    runs.clear()
    hit = lines.join(small(frequent), ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = written(hit.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("pos")).alias("at")), "gone")
    removed(spark, path)
    consumed(frequent)
    return gone


def without_repeated_lines(docs: DataFrame, **law: int) -> DataFrame:
    """Every row's doc_id, text without the lines that go, lines before and lines dropped. Keywords as of ``dropped_lines``."""
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("text"), F.xxhash64(own).alias("t"))
    gone = dropped_lines(docs, **law).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "at")
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["d"]) & (rows["t"] == gone["u"]), "left")
    rows = rows.withColumn("lines", F.split("text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("at"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("at").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
