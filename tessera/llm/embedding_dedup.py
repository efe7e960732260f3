"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Vectors equal bit for bit under one label are one class with a count; classes are
   keyed by a SHA-256 digest of label and components, so that no two vectors that
   differ are taken for one.
2. On a bounded sample, rotations are learnt that make sign codes balanced and close
   to the vectors (iterative quantisation: alternate codes and the orthogonal
   Procrustes rotation), one for each size of vector. The code is cut into substrings
   of ``s`` bits, one table each; ``s`` grows with the logarithm of the largest label
   so that buckets stay small. There are more tables than bits that a near pair's
   codes differ in, so that some substring is equal without a search around it: their
   number follows from the bit error at the threshold, so that a pair there is met
   with probability ``RECALL``.
3. Only buckets of more than a block are cut, into tiles of two blocks, whatever their
   size (a block holds ``BLOCK`` components), and every tile is compared with the
   original vectors in double precision. A vector travels with its packed code. A pair
   counts in the first table that brings it together. A tile returns a count and a
   root for each vector, never its pairs, so that groups of near copies stay linear
   in what is shuffled back.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows without label link with nothing; finite vectors of any magnitude
are scaled by a power of two first; vectors of different sizes are never compared;
sizes of which fewer vectors than components are known use a fixed random rotation;
every row is a node of its own: rows with equal vec_id are compared and linked like
others, a null vec_id is no candidate for the smallest one, and a component of rows
without id has none (all its rows are kept).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeing, sample_below, small, table, written
from tessera.llm.graph import components

COSINE, RECALL = 0.93, 0.99
SAMPLE, BUCKET = 4096, 256
#: Components of a block of vectors; vectors of a block at least and at most.
BLOCK, FEWEST, MOST = 1 << 15, 64, 2048


def usable():
    """Whether a row has a label and a vector with a direction."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def layout(largest: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and number of tables for the largest label's vectors."""
    s = min(24, max(4, math.ceil(math.log2(max(largest, 1) / BUCKET + 1))))
    met = (1 - math.acos(cosine) / math.pi) ** s
    return s, math.ceil(math.log(1 - recall) / math.log(1 - met))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; powers of two are taken out first, so that no square is lost."""
    x = np.asarray(x, np.float64)
    if len(x):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(x: np.ndarray, rotations: int, steps: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and stacked rotations (d x d*rotations) by iterative quantisation of unit rows."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    centre = x.mean(axis=0) if len(x) else np.zeros(d)
    v, out = x - centre, []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps if len(x) >= d else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(r)
    return centre, np.hstack(out)


def codes_of(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray, bits: int) -> np.ndarray:
    """Packed sign codes, one row of bytes a vector."""
    return np.packbits((unit(x) - centre) @ rotation[:, :bits] >= 0, axis=1)


def keys_of(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray, s: int, tables: int) -> np.ndarray:
    """The table keys of vectors (vectors x tables)."""
    return substrings(codes_of(x, centre, rotation, s * tables), s, tables)


def substrings(codes: np.ndarray, s: int, tables: int) -> np.ndarray:
    """The substrings of packed codes as numbers (vectors x tables)."""
    bits = np.unpackbits(codes, axis=1)[:, : s * tables].astype(np.int64)
    return bits.reshape(len(codes), tables, s) @ (1 << np.arange(s, dtype=np.int64))


def _coded(reps: DataFrame, s: int, tables: int) -> DataFrame:
    spark = reps.sparkSession
    learnt = {}
    for d, n in reps.groupBy("d").count().collect():  # sizes of vectors are few
        own = sample_below(reps.filter(F.col("d") == d), n, SAMPLE, "h").orderBy("h")  # alike however rows are numbered
        x = np.array([r["embedding"] for r in own.select("embedding").collect()], np.float64)
        learnt[d] = learn(unit(x.reshape(len(x), d)), -(-s * tables // d))
    shared = spark.sparkContext.broadcast(learnt)

    def code(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            codes = np.zeros((len(size), -(-s * tables // 8)), np.uint8)
            rows = batch.column("embedding")
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = rows.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)
                codes[own] = codes_of(x, *shared.value[int(d)], s * tables)
            keys = substrings(codes, s, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, lists], names=[*batch.schema.names, "code", "keys"])

    kind = reps.schema["embedding"].dataType.simpleString()
    return reps.drop("h").mapInArrow(freeing(code), f"id long, n long, label string, d int, embedding {kind}, code binary, keys array<long>")


def compare(ids, counts, x, keys, block, table_, first, second):
    """Link counts and roots of one tile: rows of block ``first`` against rows of block ``second``."""
    v = unit(x)
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    met = [np.nonzero(v[a[k : k + 512]] @ v[b].T >= COSINE) for k in range(0, len(a), 512)]
    i = np.concatenate([a[k * 512 + x] for k, (x, _) in enumerate(met)] or [a])
    j = np.concatenate([b[y] for _, y in met] or [a])
    if first == second:
        i, j = i[i < j], j[i < j]
    new = ~(keys[i, :table_] == keys[j, :table_]).any(axis=1) if table_ else np.ones(len(i), bool)
    add = np.bincount(i[new], counts[j[new]], len(ids)) + np.bincount(j[new], counts[i[new]], len(ids))
    root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    return add.astype(np.int64), np.sort(ids)[root]


_TILE = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _tile(s: int, tables: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        if len(ids) < 2:
            return _TILE.empty_table()
        x = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        codes = np.array([np.frombuffer(c, np.uint8) for c in group.column("code").to_pylist()])
        at = [group.column(c)[0].as_py() for c in ("t", "first", "second")]
        add, root = compare(ids, group.column("n").to_numpy(), x, substrings(codes, s, tables), group.column("block").to_numpy(), *at)
        some = (add > 0) | (root != ids)
        return pa.table([ids[some], add[some], root[some]], schema=_TILE)

    return run


def _digest():
    """A text digest of label and components: equal only for equal ones."""
    parts = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",")
    return F.sha2(F.concat(parts, F.lit("|"), F.col("label")).cast("binary"), 256)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Each vector's number of links, component and whether it is the one kept."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    marked = marked.withColumn("ok", usable()).withColumn("h", F.when(F.col("ok"), _digest()))
    # rows of a class have equal labels and vectors, so any of them stands for all
    rep = F.first(F.struct("label", "embedding")).alias("rep")
    classes = marked.filter("ok").groupBy("h").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), rep)
    classes = classes.select("h", "low", "n", "rep.label", "rep.embedding", F.size("rep.embedding").alias("d"))
    # the table is written, so its rows keep their numbers
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = classes.select("h", "id", "n", "label", "d", "embedding")
    largest = reps.groupBy("label", "d").count().agg(F.max("count")).first()[0] or 0
    s, tables = layout(largest)
    if largest:
        coded = written(_coded(reps, s, tables), "codes")
    else:
        coded = reps.drop("h").withColumn("code", F.lit(None).cast("binary")).withColumn("keys", F.lit(None).cast("array<long>"))
    bucket = ["label", "d", "t", "key"]
    placed = coded.select("id", "n", "label", "d", "embedding", "code", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("size"))
    block = F.least(F.greatest(F.floor(BLOCK / F.col("d")), F.lit(FEWEST)), F.lit(MOST))
    crowded = sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).filter("blocks > 1").select(*bucket, "blocks")
    placed = placed.join(small(written(crowded, "crowded")), bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "t"), "blocks").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = placed.withColumn("other", others).select(
        "*", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    found = tiles.groupBy(*bucket, "first", "second").applyInArrow(_tile(s, tables), "id long, links long, root long")
    found = written(found.groupBy("id", "root").agg(F.sum("links").alias("links")), "found")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("h", "id", "n", "low").join(linked, "id", "left").join(comp, "id", "left")
    named = written(named.withColumn("c", F.coalesce("component", "id")), "named")
    least = named.groupBy("c").agg(F.min("low").alias("least"))
    named = named.join(least, "c").select("h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least")
    out = marked.select("vec_id", "ok", "h").join(named, "h", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple]) -> dict:
    """(n_links, component_id) of each (vec_id, vector, label) by comparing all pairs (for tests)."""

    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, v, a) in enumerate(rows):
        for j, w, b in rows[k + 1 :]:
            if a == b and fine(v, a) and fine(w, b) and len(v) == len(w):
                x, y = np.array(v, float) / np.abs(v).max(), np.array(w, float) / np.abs(w).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= COSINE:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}
