"""Sharding by vector bin packing over bytes, tokens and rows.

What is packed are groups of equal texts. A group that holds more than 1/``PARTS`` of
a shard's bytes or rows is large and is packed by itself (there are at most
2 x ``PARTS`` of them a shard); the many small ones are dealt to ``BUCKETS`` buckets
by a hash of the text, a group whole in one bucket, so that the table that is packed
is bounded, whatever the number of documents. Large groups and buckets go, largest
first, to the shard where the dot product of their vector (bytes, tokens, rows, in
shares of the mean shard) with the shard's residual capacity is highest among those
whose bytes still fit; then they move or swap between shards while that lessens the
squared deviation of all three, and at last while it evens the bytes. The law that
holds is ``bytes``: the shards' sizes are near equal; tokens and rows are balanced as
far as that leaves room.

A group that fits a shard stays whole in it. Only one of more than a shard is split,
into pieces of a shard at most, and, where whole groups would leave the shards' bytes
more than ``SPREAD`` apart, those of more than a half, a quarter, ... of a shard.

A row's slot is its bucket's offset in the shard and its number inside the bucket
(large groups count in ``PARTS`` sub-buckets), so no shard and no group is sorted in
one task.

Edge cases: null text has no bytes and the checksum of an empty one; an empty table
gives no rows; repeated rows, and rows without id, each have a slot, and a large group
is dealt by row, whatever its ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.tokens import n_tokens

SHARDS, OVERHEAD = 40, 16
#: Buckets of small groups; the share of a shard above which a group is packed by itself; bytes' greatest spread.
BUCKETS, PARTS, SPREAD = 8192, 32, 0.01
#: Weights of bytes, tokens and rows, and units of a shard that are tried for a swap at most (evenly over their sizes).
WEIGHTS, TRIED = np.array([4.0, 1.0, 1.0]), 400


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (rows: bytes, tokens, rows)."""
    n = len(sizes)
    shard = np.zeros(n, int)
    if not n:
        return shard
    mean = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    v = sizes / mean
    load = np.zeros((shards, 3))
    for k in np.argsort(-v[:, 0], kind="stable"):
        residual = 1 - load
        fits = load[:, 0] + v[k, 0] <= 1
        if fits.any():
            best = np.where(fits, residual @ v[k], -np.inf).argmax()
        else:
            best = load[:, 0].argmin()
        shard[k] = best
        load[best] += v[k]
    return _even_out(sizes[:, 0].astype(np.int64), v, _balance(v, shard, shards), shards)


def _tried(units: np.ndarray, size: np.ndarray) -> np.ndarray:
    if len(units) <= TRIED:
        return units
    order = units[np.argsort(size[units], kind="stable")]
    return order[np.linspace(0, len(order) - 1, TRIED).astype(int)]


def _balance(v: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 600) -> np.ndarray:
    """Move or swap units between the fullest and the emptiest shard of a measure while all three come nearer the mean."""
    load = np.stack([np.bincount(shard, v[:, d], shards) for d in range(3)], axis=1)
    v0 = np.vstack((v, np.zeros(3)))  # the last one is no unit: a move instead of a swap
    for _ in range(rounds):
        for d in np.argsort(-(load.max(axis=0) - load.min(axis=0)) * WEIGHTS, kind="stable"):
            high, low = int(load[:, d].argmax()), int(load[:, d].argmin())
            mine = _tried(np.flatnonzero(shard == high), v[:, d])
            theirs = np.append(_tried(np.flatnonzero(shard == low), v[:, d]), len(v))
            step = v0[mine][:, None, :] - v0[theirs][None, :, :]
            # change of the two shards' squared deviations
            change = (2 * step * (step - (load[high] - load[low]))) @ WEIGHTS
            if change.size and change.min() < -1e-9:
                a, b = np.unravel_index(change.argmin(), change.shape)
                load[high] -= step[a, b]
                load[low] += step[a, b]
                shard[mine[a]] = low
                if theirs[b] < len(v):
                    shard[theirs[b]] = high
                break
        else:
            break
    return shard


def _even_out(size: np.ndarray, v: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 2000) -> np.ndarray:
    """Move or swap units between the shards of most and least bytes while that evens them, tokens and rows moving little."""
    load = np.bincount(shard, size, shards).astype(np.int64)
    mean = max(size.sum() / shards, 1)
    for _ in range(rounds):
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        if gap <= 1:
            break
        mine, other = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
        theirs = np.concatenate(([0], size[other]))
        rest = np.vstack((np.zeros(2), v[other, 1:]))
        order = np.argsort(theirs, kind="stable")
        # moving a unit of size a for one of size b (0: none) leaves a gap of |gap - 2 (a - b)|
        want = size[mine] - gap / 2
        at = np.clip(np.searchsorted(theirs[order], want), 0, len(order) - 1)
        near = order[np.stack([np.clip(at + k, 0, len(order) - 1) for k in range(-4, 4)])]
        left = np.abs(gap - 2 * (size[mine] - theirs[near]))
        moved = np.abs(v[mine, 1:] - rest[near]).sum(axis=2)
        cost = np.where(left < gap, left / mean + 0.02 * moved, np.inf)
        row, col = np.unravel_index(cost.argmin(), cost.shape)
        if not np.isfinite(cost[row, col]):
            break
        a, b = mine[col], near[row, col]
        shard[a] = low
        load[high], load[low] = load[high] - size[a], load[low] + size[a]
        if b:
            c = other[b - 1]
            shard[c] = high
            load[high], load[low] = load[high] + size[c], load[low] - size[c]
    return shard


def pieces_of(units: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Pieces of the large groups (columns key, large, b, t, n, share): 1 where they stay whole."""
    large = units[units["large"]]
    for part in (1, 2, 4, 8, 16, PARTS):
        pieces = np.maximum(1, np.minimum(np.ceil(large["share"].to_numpy() * part), large["n"].to_numpy())).astype(int)
        cut = large.loc[large.index.repeat(pieces), ["b", "t", "n"]].to_numpy(float) / np.repeat(pieces, pieces)[:, None]
        sizes = np.vstack((units.loc[~units["large"], ["b", "t", "n"]].to_numpy(float), cut))
        load = np.bincount(place(sizes, shards), sizes[:, 0], shards)
        if part == PARTS or load.max() - load.min() <= SPREAD * load.mean():
            break
    return large.assign(pieces=pieces)[["key", "pieces"]]


def sharded(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, buckets: int = BUCKETS) -> DataFrame:
    """Every document's size, shard and slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        n_tokens()(text).alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("row"),  # the table is written, so its rows keep their numbers
    )
    rows = written(rows, "sizes")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    groups = rows.groupBy("h").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    share = F.greatest(F.col("b") / max(total or 0, 1), F.col("n") / max(count or 0, 1)) * shards
    groups = groups.withColumn("share", share).withColumn("large", F.col("share") > 1 / PARTS)
    groups = groups.withColumn("key", F.when(F.col("large"), F.col("h")).otherwise(F.pmod("h", F.lit(buckets))))
    sums = [F.sum(c).alias(c) for c in ("b", "t", "n")]
    # large groups' shares sum to 2 * shards at most, so there are at most 2 * shards * PARTS of them
    units = groups.groupBy("key", "large").agg(*sums, F.sum("share").alias("share")).orderBy("large", "key").toPandas()
    cut = pieces_of(units, shards)
    large = spark.createDataFrame([tuple(map(int, r)) for r in cut.itertuples(index=False)], "h long, pieces int")
    known = rows.join(F.broadcast(large), "h", "left")
    # a large group's rows are dealt in turn within each part of the written table, so its pieces differ by a row a part
    part = F.shiftright("row", 33)
    turn = F.row_number().over(Window.partitionBy("h", part).orderBy("row")) + F.pmod(F.xxhash64("h", part), F.col("pieces"))
    fields = ["doc_id", "size", "tokens", "text_crc32", "row"]
    alone = known.filter("pieces IS NOT NULL").select(
        *fields, F.col("h").alias("key"), F.pmod(turn, F.col("pieces")).cast("int").alias("piece"), F.pmod(F.xxhash64("row", F.lit(5)), F.lit(PARTS)).cast("int").alias("sub")
    )
    dealt = known.filter("pieces IS NULL").select(*fields, F.pmod("h", F.lit(buckets)).alias("key"), F.lit(-1).alias("piece"), F.lit(0).alias("sub"))
    known = alone.unionByName(dealt)
    bucket = ["key", "piece", "sub"]
    subs = known.groupBy(*bucket).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    subs = subs.orderBy(*bucket).toPandas()
    unit = subs.groupby(["key", "piece"], as_index=False)[["b", "t", "n"]].sum()
    unit["shard"] = place(unit[["b", "t", "n"]].to_numpy(float).reshape(-1, 3), shards).astype("int32")
    subs = subs.merge(unit[["key", "piece", "shard"]], on=["key", "piece"])
    subs["first"] = subs.groupby("shard")["n"].cumsum() - subs["n"]
    places = spark.createDataFrame(
        [tuple(map(int, r)) for r in subs[[*bucket, "shard", "first"]].itertuples(index=False)],
        "key long, piece int, sub int, shard int, first long",
    )
    inside = Window.partitionBy(*bucket).orderBy("doc_id", "text_crc32", "row")
    return (
        known.withColumn("r", F.row_number().over(inside) - 1)
        .join(F.broadcast(places), bucket)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
