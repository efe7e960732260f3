"""Shared pieces: table access, written intermediate tables, byte-plane text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handled at once by the kernels; bounds a worker's memory.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Ids broadcast at most (8 bytes each); beyond that Spark joins by shuffling.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL.setdefault(app, _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives lost executors and is computed once, however often it is
    read. ``consumed`` deletes it; what is left is the cluster's to clear after the job.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.folder = path
    return table_


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store whose rows nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def consumed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, when what was made from them is written itself."""
    for df in tables:
        removed(df.sparkSession, df.folder)


def lean(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows: whole texts are long, and a batch is held by Spark and by its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    # Spark 4.1 may take a union's parts for dealt alike when they are not
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def freeing(run):
    """``run``, and afterwards what the task has used goes back to the system: workers live on."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 3 is 1: rows no model may learn from; rows without an id count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only where it is counted to hold at most ``rows`` rows of ids."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in the written table ``ids``; columns and their order stay."""
    return docs.join(small(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])


def sample_below(df: DataFrame, rows: int, most: int, key: str = "doc_id") -> DataFrame:
    """A repeatable sample of about ``most`` of ``rows`` rows, by a hash of ``key``."""
    if rows <= most:
        return df
    share = int(most / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < share)


# ---- byte-plane kernels -------------------------------------------------------
# A batch's texts lie one after another in one byte array. Words of all texts are
# found, hashed and windowed with a fixed number of numpy calls for each slice.


def text_plane(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    data, n = column.buffers()[2], len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    plane = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return plane[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(batch: pa.RecordBatch, *texts: str, most: int = SLICE_BYTES, rows: int = 1 << 14):
    """Cut a batch into runs of at most ``rows`` rows and about ``most`` text bytes (one row at least)."""
    ends = np.zeros(batch.num_rows, np.int64)
    for text in texts or ("text",):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
        ends += np.asarray(sizes.to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(ends)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + most, "right"))), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


_RNG = np.random.default_rng(20240607)
_BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, at least ``n`` of them."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n).bit_length())
        steps = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        have = _POWERS["p"] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(plane: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, none across two texts, and the texts' first word numbers."""
    return run_spans(is_word[plane], offsets)


def run_spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_spans``, for the word bytes' own flags."""
    inside = np.zeros(len(flags) + 2, bool)
    inside[1:-1] = flags
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    if len(flags):
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(flags))]
        begins[cuts] = inside[1:-1][cuts]
        stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(plane: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], sizes)
    at = place + np.repeat(starts, sizes)
    part = _BYTE_HASH[plane[at]] * _powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(part, total[:-1]) + sizes.astype(np.uint64))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of ``width`` words and the number of the text of each.

    A text of fewer words, but some, has one window of all its words.
    """
    counts = np.diff(first)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        sums[: n - k] += words[k:] * odd[k]
    text_of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(first[:-1], counts)
    whole = place + width <= np.repeat(counts, counts)
    hashes, owner = mix(sums[whole]), text_of[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        mine = (counts[text_of] < width)
        part = words[mine] * odd[place[mine]]
        starts = np.concatenate(([0], np.cumsum(counts[short])[:-1]))
        own = mix(np.add.reduceat(part, starts) + counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        hashes, owner = np.concatenate((hashes, own)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def ascii_lower(plane: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[plane]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
