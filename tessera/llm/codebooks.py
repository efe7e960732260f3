"""Compression of vectors to codebook indexes, learnt by Lloyd rounds with Elkan's bounds.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts;
each part position has a codebook. Every vector's row keeps its code and, for each part,
an upper bound of the distance to its entry and one lower bound for every entry. The
first round computes all distances of a part; later ones shift the bounds by the
entries' movements and compute only what a strict comparison of an upper bound with a
lower bound, or with half the way between two entries, leaves open. Distances are exact
integers and the smaller index wins a tie, so the codes are those of comparing
everything. Lower bounds are kept in half precision, rounded down (they only say less),
upper ones in single precision, rounded up.

The table of vectors and bounds is a written one; a round reads it once with the
codebooks (parts x entries rows, broadcast), writes the next one and deletes the old.
Sums by part and entry are gathered in each task before they are shuffled.

Edge cases: null vectors and those with null or non-finite components are left out;
vectors shorter than the longest one are filled with zeros, all of them to a multiple
of the number of parts; components beyond +-2**24 after scaling count as +-2**24, and
sums that pass 64 bits stay at the greatest one; with fewer vectors than entries each
is one; equal ids are ordered by vector, null ones come last; rows without label share
one label sum; an empty table gives no rows; repeated rows each give one; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import consumed, small, table, written
from tessera.llm.kmeans import above, apart, below, finite, squared, total, whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2


def kept_above(d: np.ndarray) -> np.ndarray:
    """Single precision, not below ``d``."""
    near = np.asarray(d, float).astype(np.float32)
    return np.where(near < d, np.nextafter(near, np.float32(np.inf)), near)


def kept_below(d: np.ndarray) -> np.ndarray:
    """Half precision, not above ``d``; greater ones than it can hold become its greatest."""
    near = np.minimum(d, 65504.0).astype(np.float16)
    return np.where(near > d, np.nextafter(near, np.float16(-1)), near)


def first_codes(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds of one part position from all distances."""
    d = squared(x[:, None, :], book[None, :, :])
    code = d.argmin(axis=1)
    return code, above(np.sqrt(above(d[np.arange(len(x)), code]))), below(np.sqrt(below(d)))


def next_codes(x, code, upper, lower, book, half, moved) -> int:
    """Shift the bounds of one part position and settle its codes, in place; distances that were computed."""
    rows = np.arange(len(x))
    upper[:] = above(upper + moved[code])
    lower[:] = np.maximum(0.0, below(lower - moved))
    needed = ~(upper[:, None] < lower) & ~(upper[:, None] < half[code])
    needed[rows, code] = False
    ask = np.flatnonzero(needed.any(axis=1))
    if not len(ask):
        return 0
    own = squared(x[ask], book[code[ask]])
    upper[ask] = above(np.sqrt(above(own)))
    lower[ask, code[ask]] = below(np.sqrt(below(own)))
    still = needed[ask] & ~(upper[ask, None] < lower[ask]) & ~(upper[ask, None] < half[code[ask]])
    i, j = np.nonzero(still)
    d = squared(x[ask[i]], book[j])
    lower[ask[i], j] = below(np.sqrt(below(d)))
    every = np.full(still.shape, np.iinfo(np.int64).max)
    every[i, j] = d
    every[np.arange(len(ask)), code[ask]] = own
    best = every.argmin(axis=1)  # the smaller index wins a tie
    code[ask] = best
    upper[ask] = above(np.sqrt(above(every[np.arange(len(ask)), best])))
    return len(ask) + len(i)


_STATE = "vec_id long, label string, v array<int>, code binary, upper binary, lower binary, error long, computed long"


def _packed(rows: np.ndarray) -> pa.Array:
    size, data = rows[0].nbytes, np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """One pass over the vectors; ``books`` is parts x entries x components of a part."""
    parts, entries, _ = books.shape
    kind = np.uint8 if entries <= 256 else np.uint32
    halves = np.array([apart(b) for b in books])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, -1)
            code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, entries))
            counts, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if moved is not None:
                code[:] = _unpacked(batch.column("code"), kind, (parts,))
                upper[:] = _unpacked(batch.column("upper"), np.float32, (parts,))
                lower[:] = _unpacked(batch.column("lower"), np.float16, (parts, entries))
            for p in range(parts):
                if moved is None:
                    code[:, p], upper[:, p], lower[:, p] = first_codes(x[:, p], books[p])
                    counts[0] += n * entries
                else:
                    own = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    counts[0] += next_codes(x[:, p], *own, books[p], halves[p], moved[p])
                    code[:, p], upper[:, p], lower[:, p] = own
                if last:
                    error += squared(x[:, p], books[p][code[:, p]])
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), _packed(code.astype(kind)), _packed(kept_above(upper)), _packed(kept_below(lower)), pa.array(error), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "code", "upper", "lower", "error", "computed"])

    return state.mapInArrow(run, _STATE)


def moved_to(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after their parts' componentwise floor(sum / count); unused ones stay."""
    parts, entries, width = books.shape
    kind = np.uint8 if entries <= 256 else np.uint32

    def run(batches):
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            at = (_unpacked(batch.column("code"), kind, (parts,)).astype(np.int64) + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], names=["entry", "n", "s"])

    found = state.select("v", "code").mapInArrow(run, "entry long, n long, s array<long>")
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = books.copy().reshape(parts * entries, width)
    for r in found.groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows at most
        out[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out.reshape(books.shape)


def compressed(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(vec_id, label, code, error, computed) of every vector, a written table, and the codebooks (parts x entries x components).

    ``code`` holds one byte a part (four beyond 256 entries). ``computed`` counts
    distances of a batch on its first row, for the last round.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    own = own.filter(finite(F.col("embedding")))
    longest = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    size = max(-(-longest // parts), 1) * parts
    v = whole_numbers(F.col("embedding"), scale)
    filled = F.concat(v, F.array_repeat(F.lit(0), F.lit(size) - F.size("embedding")))
    state = written(own.select("vec_id", "label", filled.alias("v")), "vectors")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books, moved = np.array([r["v"] for r in first], np.int64).reshape(-1, parts, size // parts).transpose(1, 0, 2).copy(), None
    for k in range(rounds + 1):
        now = written(_round(state, books, moved, k == rounds), "bounds")
        consumed(state)
        state = now
        if k < rounds:
            new = moved_to(state, books)
            moved = above(np.sqrt(above(squared(new, books))))
            books = new
    return state.select("vec_id", "label", "code", "error", "computed"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = rows.groupBy("label").agg(total("error").alias("label_error")).withColumnRenamed("label", "l")
    rows = rows.join(small(sums), rows["label"].eqNullSafe(F.col("l")), "left")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(name).alias("codebooks_sha256"))
