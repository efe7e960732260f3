"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of five words. Its sketch has ``T``
coordinates, filled in rounds: in round r < T every shingle falls into one hashed
bin with the value (r, hash), in round T + b every shingle falls into bin b; a bin
keeps the least value. So every coordinate is filled, earlier rounds win, and equal
coordinates estimate the Jaccard similarity with concentration bounds. Bands of
``ROWS`` coordinates give the candidates: at similarity 0.75, 32 bands of 4 miss a
pair with probability 5e-6.

Documents with equal sets are one class and only its representative goes on.
In each band bucket the members are compared with ``STARS`` of them, never all with
all. Members that are then still in different components are paired, if their set
sizes, the counts of their shingles in ``CELLS`` hash cells (without those that none
of the others has, the cells' lesser counts bound the intersection, exactly) and four
bits of each coordinate (a pair at 0.75 fails them with probability 1e-6) allow the
similarity; crowded buckets are paired in tiles. Comparisons count the whole sets'
common shingles.

Edge cases: null, empty or blank text has an empty set and is linked with nothing;
fewer than five words make one shingle; rows with equal doc_id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import (
    freeing,
    ascii_lower,
    mix,
    slices,
    small,
    table,
    text_plane,
    window_hashes,
    without,
    word_hashes,
    word_spans,
    written,
)
from tessera.llm.graph import components

WIDTH, PERCENT = 5, 75
T, ROWS = 128, 4
BANDS = T // ROWS
#: Members of a bucket that all others are compared with: the least, and others that differ from bucket to bucket.
STARS = 4
#: Bits of the 4 * T that may differ: 4 T (1 - J) / 2 at J = 0.75, and five deviations.
MOST_BITS = 120
#: Hash cells whose counts bound an intersection, members of a bucket's block.
CELLS, BLOCK = 64, 1024

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_OWNER_BITS = np.uint64(14)
_ID_BITS = np.uint64(50)
_ID_MASK = np.uint64((1 << 50) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_keys(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct keys of (row number, shingle) for a column of at most 2**14 texts."""
    plane, offsets = text_plane(column)
    plane = ascii_lower(plane)
    starts, ends, first = word_spans(plane, offsets, _IS_WORD)
    hashes, owner = window_hashes(word_hashes(plane, starts, ends), first, width)
    keys = (owner.astype(np.uint64) << _ID_BITS) | (hashes >> _OWNER_BITS)
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def sketch(ids: np.ndarray, owner: np.ndarray, n: int, t: int = T) -> np.ndarray:
    """The n x t sketch of the sets given by (owner, id) rows; rows of empty sets stay unfilled."""
    bins = np.full(n * t, _NONE, np.uint64)
    seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64))
    for r in range(2 * t):
        if not len(ids):
            break
        h = mix(ids ^ seeds[r])
        value = (h & np.uint64((1 << 40) - 1)) | np.uint64(r << 40)
        place = (h >> np.uint64(44)).astype(np.int64) % t if r < t else r - t
        np.minimum.at(bins, owner * t + place, value)
        full = (bins.reshape(n, t) != _NONE).all(axis=1)
        going = ~full[owner]
        if not going.all():
            ids, owner = ids[going], owner[going]
    return bins.reshape(n, t)


def band_hashes(bins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = bins.shape
    cut = bins.reshape(n, t // rows, rows)
    out = mix(np.arange(t // rows, dtype=np.uint64) + np.uint64(77))[None, :].repeat(n, axis=0)
    for k in range(rows):
        out = mix(out ^ cut[:, :, k]) + np.uint64(k)
    return out.view(np.int64)


def packed_bits(bins: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate, as 64-bit integers."""
    four = np.ascontiguousarray(mix(bins) >> np.uint64(60)).astype(np.uint8)
    return np.ascontiguousarray(four[:, 0::2] << 4 | four[:, 1::2]).view(np.int64)


_SIG = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
_SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _signatures(batches):
    for whole in batches:
        for batch in slices(whole):
            n = batch.num_rows
            keys = shingle_keys(batch.column("text"))
            ids, owner = keys & _ID_MASK, (keys >> _ID_BITS).astype(np.int64)
            counts = np.bincount(owner, minlength=n)
            sets = np.zeros((2, n), np.uint64)
            filled = np.flatnonzero(counts)
            if len(filled):
                at = (np.cumsum(counts) - counts)[filled]
                for k in (0, 1):
                    sets[k, filled] = np.add.reduceat(mix(ids + np.uint64(k << 60)), at)
            bins = sketch(ids, owner, n)[filled]
            lists = lambda rows: pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum((counts > 0) * rows.shape[1]))), pa.int32()), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(sets[0].view(np.int64)),
                    pa.array(sets[1].view(np.int64)),
                    lists(band_hashes(bins)),
                    lists(packed_bits(bins)),
                ],
                schema=_SIG_ARROW,
            )


def _confirmed(batches):
    """Pairs whose texts' whole sets reach the similarity."""
    for whole in batches:
        for batch in slices(whole, "text_a", "text_b"):
            n = batch.num_rows
            a, b = shingle_keys(batch.column("text_a")), shingle_keys(batch.column("text_b"))
            row = lambda keys: np.bincount((keys >> _ID_BITS).astype(np.int64), minlength=n)
            both = row(np.intersect1d(a, b, assume_unique=True))
            union = row(a) + row(b) - both
            yield batch.select(["a", "b"]).filter(pa.array((both > 0) & (100 * both >= PERCENT * union)))


def _sets(batches):
    for whole in batches:
        for batch in slices(whole):
            keys = shingle_keys(batch.column("text"))
            ids = batch.column("doc_id").take(pa.array((keys >> _ID_BITS).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array((keys & _ID_MASK).astype(np.int64))], names=["id", "shingle"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(freeing(_confirmed), "a long, b long"), "links")


def _in_components(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Bucket members with their components, of buckets that hold more than one component."""
    named = buckets.join(comp.withColumnRenamed("id", "doc"), F.col("id") == F.col("doc"), "left").select(
        "h", "id", F.coalesce("component", "id").alias("c")
    )
    mixed = named.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h")
    return named.join(mixed, "h")


def _left_over(mixed: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of bucket members in different components that may still have the similarity."""
    mixed = written(mixed, "mixed")
    ids = written(mixed.select(F.col("id").alias("doc_id")).distinct(), "ids")
    rows = texts.join(small(ids), "doc_id", "left_semi").mapInArrow(freeing(_sets), "id long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other")
    by_cell = lambda rows, c: rows.groupBy("id").agg(
        *[F.count_if(F.pmod("shingle", F.lit(CELLS)) == k).alias(f"{c}{k}") for k in range(CELLS)]
    )
    alone = by_cell(alone, "u")
    bits = [F.col("bits")[k].alias(f"x{k}") for k in range(T // 16)]
    sets = reps.join(small(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *bits)
    shared = [(F.col(f"m{k}") - F.coalesce(f"u{k}", F.lit(0))).cast("int").alias(f"c{k}") for k in range(CELLS)]
    sets = sets.join(by_cell(rows, "m").join(alone, "id", "left").select("id", *shared), "id")
    # two sets of a link share PERCENT / (100 + PERCENT) of their sizes' sum or more, and the other has PERCENT % of n at least
    most = sum((F.col(f"c{k}") for k in range(CELLS)), F.lit(0))
    known = written(mixed.join(sets.filter((100 + PERCENT) * most * 100 >= PERCENT * (100 + PERCENT) * F.col("n")), "id"), "open")
    # a crowded bucket is cut to blocks, and its members meet in tiles of two blocks: no key holds more than one tile
    sizes = known.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    known = known.join(small(written(sizes, "crowded")), "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    known = known.withColumn("block", F.pmod(F.xxhash64("id", "h"), "blocks").cast("int"))
    known = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda s, first, second: known.select(F.struct("h", F.col(first).alias("i"), F.col(second).alias("j")).alias("h"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "c", "n", *[f"x{k}" for k in range(T // 16)], *[f"c{k}" for k in range(CELLS)])])
    one, two = side("a", "block", "other"), side("b", "other", "block")
    differ = sum((F.bit_count(F.col(f"a_x{k}").bitwiseXOR(F.col(f"b_x{k}"))) for k in range(T // 16)), F.lit(0))
    common = sum((F.least(f"a_c{k}", f"b_c{k}") for k in range(CELLS)), F.lit(0))
    fits = (
        (F.col("a_id") < F.col("b_id"))
        & (F.col("a_c") != F.col("b_c"))
        & (100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n"))
        & (differ <= MOST_BITS)
        & ((100 + PERCENT) * common >= PERCENT * (F.col("a_n") + F.col("b_n")))
    )
    both = one.withColumnRenamed("h", "h_a").join(two.withColumnRenamed("h", "h_b"), (F.col("h_a") == F.col("h_b")) & fits)
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def links_of(docs: DataFrame, sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between representatives that settle all components, as components so far."""
    reps = sig.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("h"))
    first = [F.min(F.struct((F.xxhash64("id", "h", F.lit(k)) if k else F.col("id")).alias("o"), "id"))["id"].alias(f"s{k}") for k in range(STARS)]
    crowded = banded.groupBy("h").agg(F.count("*").alias("n"), *first).filter("n > 1").drop("n")
    buckets = written(banded.join(crowded, "h"), "buckets")
    need = written(buckets.select(F.col("id").alias("doc_id")).distinct(), "need")
    texts = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
            small(need), "doc_id", "left_semi"
        ),
        "texts",
    )
    stars = buckets.select("id", F.explode(F.array_distinct(F.array(*[f"s{k}" for k in range(STARS)]))).alias("s"))
    pairs = stars.filter("id <> s").select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b")).distinct()
    links = _verify(pairs, texts)
    comp = components(links)
    late = _verify(_left_over(_in_components(buckets.select("h", "id"), comp), reps, texts), texts)
    return comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Each document's set size, component and whether it is the one kept."""
    sig = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(_signatures), _SIG), "sketches")
    classes = written(sig.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    comp = components(links_of(docs, sig, classes))
    named = classes.join(comp, F.col("rep") == F.col("id"), "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("c")
    )
    own = F.when(F.col("n_shingles") > 0, F.col("c"))
    out = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns."""
    return without(docs, written(near_duplicates(docs).filter("NOT kept").select("doc_id"), "copies"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingles(text: str | None, width: int = WIDTH) -> set:
    """A text's set, word by word (for tests)."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute_force(rows: list[tuple]) -> dict:
    """(n_shingles, component_id, kept) of each document by comparing all pairs (for tests)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
