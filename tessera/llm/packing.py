"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids ended by one separator; only those longer than a
sequence are cut, so that the first piece takes the remainder and the others are
full. Lengths are small integers, so packing works on their histogram, whose size
doesn't grow with the corpus: for a bin, a bitset of reachable sums over the lengths
still available finds the fullest feasible combination (the largest length left is
always in it); the combination is then removed as often as the histogram holds it,
which uses up one length at least. So there are at most ``SIZE`` different
combinations, whatever the number of documents.

The plan is a small table of (length, first rank, repeats, first sequence, offset).
A piece's rank among those of its length comes from counts by (length, bucket) and
a row number inside a bucket; the number of buckets grows with the pieces, so that no
length, however frequent, meets in one task. Full pieces are a sequence each and take
part in none of this: their sequences have negative numbers.

Token ids are those of the ``byte_bpe_50k`` vocabulary; they are computed by the
rank form of the same vocabulary, which gives the same ids (tests compare them with
the ``tokenizers`` form) in a third of the time. Added tokens of its file
(``<|endoftext|>``) that stand in a text are their own ids there and here.

Edge cases: null text is an empty one and gives the separator alone; repeated rows
are packed each by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import freeing, slices, table, written
from tessera.llm.tokens import byte_bpe

SIZE, SEPARATOR = 1024, 2
#: Buckets over which a length's ranks are spread at least, and pieces of a bucket at most (about).
BUCKETS, BUCKET_ROWS = 512, 50_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first takes the remainder, the rest are full."""
    first = n % size or min(n, size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """Every document's pieces with a checksum of their ids."""

    def run(batches):
        encode = byte_bpe()
        for whole in batches:
            for batch in slices(whole):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), separator], "<u4")
                    for k, (at, n) in enumerate(cuts(len(ids), size)):
                        out.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(run), _PIECES)


def fullest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """A combination of available lengths (ascending) whose sum is the largest up to ``room``."""
    reach, layers = 1, [1]
    mask = (1 << (room + 1)) - 1
    for n, count in zip(lengths, counts):
        left, step = min(count, room // n), 1
        while left:  # multiples of n by doubling, so that a length costs log2(count) shifts
            take = min(step, left)
            reach |= (reach << (take * n)) & mask
            left -= take
            step *= 2
        layers.append(reach)
        if reach >> room:
            break
    best = reach.bit_length() - 1
    chosen = []
    for k in range(len(layers) - 1, 0, -1):
        n = lengths[k - 1]
        while not layers[k - 1] >> best & 1:
            chosen.append(n)
            best -= n
    return chosen


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, repeats, first sequence, offset) rows that place every piece of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        big = max(left)
        others = sorted((n for n in left if n <= size - big), reverse=True)
        counts = [left[n] - (n == big) for n in others]
        bin_ = [big, *fullest(others, counts, size - big)]
        times = min(left[n] // bin_.count(n) for n in set(bin_))
        offset = 0
        for n in bin_:
            rows.append((n, used[n], times, sequence, offset))
            used[n] += times
            offset += n
        for n in bin_:
            left[n] -= times
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def packed(docs: DataFrame, size: int = SIZE, separator: int = SEPARATOR, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces with the sequence and the place in it that they are packed to."""
    spark = docs.sparkSession
    every = written(pieces(docs, size, separator), "pieces")
    alone = (-1 - F.monotonically_increasing_id()).alias("sequence_id")  # the table is written, so its rows keep their places
    full = every.filter(F.col("length") == size).select(*_ARROW.names, alone, F.lit(0).cast("long").alias("offset"))
    cut = every.filter(F.col("length") < size)
    buckets = max(BUCKETS, -(-cut.count() // bucket_rows))
    cut = cut.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = written(cut.groupBy("length", "b").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list] = {}
    for n, rank, times, sequence, offset in plan(histogram, size):
        by_length.setdefault(n, []).append((rank, sequence, offset))
    places = {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(places)  # at most ``size`` combinations of at most ``size`` pieces
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("r", F.row_number().over(inside) - 1).join(firsts.select("length", "b", "first"), ["length", "b"])

    def place(batches):
        table_ = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                ranks, sequences, offsets = table_[int(n)]
                at = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own] = sequences[at] + rank[own] - ranks[at]
                offset[own] = offsets[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in _ARROW], pa.array(sequence), pa.array(offset)],
                names=[*_ARROW.names, "sequence_id", "offset"],
            )

    placed = ranked.select(*_ARROW.names, (F.col("first") + F.col("r")).cast("long").alias("rank"))
    return placed.mapInArrow(freeing(place), _PIECES + ", sequence_id long, offset long").unionByName(full)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
