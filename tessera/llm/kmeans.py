"""Centroid clustering of integer vectors with Elkan's bounds.

Vectors become integers, floor(scale * x). Each vector's row keeps the cluster it is
in, an upper bound of the distance to its centroid and a lower bound for every
centroid. When centroids move, an upper bound grows by the movement of its own one and
each lower bound shrinks by that of its centroid. A vector whose upper bound is
strictly below half the way to the next centroid is not looked at; for others a
centroid is left out where its lower bound, or half its way to the vector's centroid,
is strictly above the upper bound. What remains is compared by exact squared distances
of integers, the smaller number winning a tie. Bounds are doubles rounded away from
the truth after every step, and a tie never satisfies a strict comparison, so the
result is that of comparing everything.

The table of vectors and bounds is a written one; a round reads it once with the
centroids (k rows, broadcast), writes the next one and deletes the old. New centroids
come from sums by cluster, pre-aggregated in each task, and are divided exactly.

Edge cases: vectors of another size than asked for, null ones and those with null or
non-finite components are left out; components beyond +-2**24 after scaling count as
+-2**24, so that squared distances stay exact in 64 bits, and sums of them that pass
64 bits stay at the greatest one; with fewer vectors than centroids each is one; equal
first hashes (repeated ids) are ordered by vector, ids that are null come last; an
empty table gives no rows; repeated rows each give one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import consumed, table, written

SIZE, SCALE, CLUSTERS, ROUNDS, SALT = 64, 64, 16, 3, "1"
#: Greatest component after scaling: with it squared distances of 8192 components fit in 64 bits.
LIMIT = 1 << 24
#: Relative slack of a bound: more than the error of a square root, a product and a sum of doubles.
SLACK = 1e-14


def whole_numbers(embedding, scale: int):
    """A column: floor(scale * x) of every component, at most +-LIMIT."""
    most = float(LIMIT / scale)
    return F.transform(embedding, lambda x: F.floor(scale * F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double")))).cast("int"))


def finite(embedding):
    """A column: no component is null, NaN or infinite, and there is a vector."""
    every = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(embedding.isNotNull() & every, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    step = x.astype(np.int64) - c
    return (step * step).sum(axis=-1)


def above(d: np.ndarray) -> np.ndarray:
    return np.asarray(d, float) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    return np.asarray(d, float) * (1 - SLACK)


def apart(centroids: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down; infinite for one and itself."""
    half = below(np.sqrt(below(squared(centroids[:, None, :], centroids[None, :, :]))) / 2)
    np.fill_diagonal(half, np.inf)
    return half


def assign(x, cluster, upper, lower, centroids, half, moved):
    """The next cluster, upper and lower bounds of each row, and the number of distances that were computed.

    ``moved`` holds the centroids' movements, rounded up, or is None in the first
    round, when there are no bounds yet. Arrays are changed in place.
    """
    n, rows = len(x), np.arange(len(x))
    computed = 0
    if moved is None:
        cluster[:] = 0
        d = squared(x, centroids[0])
        upper[:], lower[:] = above(np.sqrt(above(d))), 0.0
        lower[:, 0] = below(np.sqrt(below(d)))
        computed += n
    else:
        upper[:] = above(upper + moved[cluster])
        lower[:] = np.maximum(0.0, below(lower - moved))
    near = half.min(axis=1) if len(half) else np.zeros(0)
    open_ = rows[~(upper < near[cluster])]
    tight = np.full(n, moved is None)
    exact = np.zeros(n, np.int64)
    if moved is None:
        exact[:] = d
    for j in range(len(centroids)):
        a = cluster[open_]
        ask = open_[(a != j) & ~(upper[open_] < lower[open_, j]) & ~(upper[open_] < half[a, j])]
        loose = ask[~tight[ask]]
        if len(loose):
            d = squared(x[loose], centroids[cluster[loose]])
            exact[loose], tight[loose] = d, True
            upper[loose] = above(np.sqrt(above(d)))
            lower[loose, cluster[loose]] = below(np.sqrt(below(d)))
            computed += len(loose)
            a = cluster[ask]
            ask = ask[~(upper[ask] < lower[ask, j]) & ~(upper[ask] < half[a, j])]
        if len(ask):
            d = squared(x[ask], centroids[j])
            computed += len(ask)
            lower[ask, j] = below(np.sqrt(below(d)))
            better = (d < exact[ask]) | ((d == exact[ask]) & (j < cluster[ask]))
            new = ask[better]
            cluster[new], exact[new] = j, d[better]
            upper[new] = above(np.sqrt(above(d[better])))
    return computed


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


_STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, distance long, computed long"


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """One pass over the vectors; ``last`` computes every vector's exact distance."""
    half = apart(centroids)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("v"), n)
            if moved is None:
                cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, len(centroids)))
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper, lower = batch.column("upper").to_numpy().copy(), _matrix(batch.column("lower"), n).copy()
            computed = assign(x, cluster, upper, lower, centroids, half, moved)
            distance = pa.array(squared(x, centroids[cluster]) if last else np.zeros(n, np.int64))
            counts = np.zeros(n, np.int64)
            counts[0] = computed
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), distance, pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "distance", "computed"])

    return state.mapInArrow(run, _STATE)


def moved_to(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after their vectors' componentwise floor(sum / count); empty ones stay."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # one row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def clustered(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT):
    """(vec_id, cluster, distance, computed) of every vector, a written table, and the final centroids.

    ``computed`` counts distances of a batch on its first row, for the last round.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    own = own.filter(finite(F.col("embedding")) & (F.size("embedding") == size))
    state = written(own.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v")), "vectors")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = state.orderBy(order.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    centroids, moved = np.array([r["v"] for r in first], np.int64).reshape(-1, size), None
    for k in range(rounds + 1):
        now = written(_round(state, centroids, moved, k == rounds), "bounds")
        consumed(state)
        state = now
        if k < rounds:
            new = moved_to(state, centroids)
            moved = above(np.sqrt(above(squared(new, centroids))))
            centroids = new
    return state.select("vec_id", "cluster", "distance", "computed"), centroids


def total(column: str):
    """A column: the sum of a long column, at most the greatest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    names = spark.createDataFrame([(k, digest(c)) for k, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    # one row for each of a fixed number of centroids
    known = F.broadcast(sums.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(rows.agg(total("distance").alias("inertia")))))
    return rows.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
