"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def sparse_top(weights: Column, least: float = 0.0, k: int | None = None) -> Column:
    """Entries (index, weight) of a map over ``least``, heaviest first, at most ``k``."""
    entries = F.map_entries(F.map_filter(weights, lambda _, w: w > least))
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("index"), e["value"].alias("weight"))))
    out = F.transform(keyed, lambda e: F.struct(e["index"].alias("index"), e["weight"].alias("weight")))
    return F.slice(out, 1, k) if k else out
