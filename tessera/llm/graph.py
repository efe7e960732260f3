"""Connected components of an undirected edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rounds after which an unfinished contraction is an error (they grow as log^2 of the longest path).
MOST_ROUNDS = 60


def _smallest(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): the smallest id reachable.

    Each round every node hands its larger, then its smaller neighbours to its
    smallest one; minima are pre-aggregated before the shuffle, and each round's
    edges are written to the shared folder. Self loops and repeated edges are
    harmless; null ends are dropped; without edges the result is empty.
    """
    star = written(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(star)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.join(_smallest(both), "u").filter(F.col("v") > F.col("u"))
        large = least.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        own = _smallest(large)
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        star = written(small.unionByName(own.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _mark(star)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = star.select(F.col("v").alias("id")).distinct()
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("id"))
    )


def _mark(star: DataFrame) -> tuple:
    """A fingerprint of the edge set: equal before and after a round only if nothing moved."""
    return tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
