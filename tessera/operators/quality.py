"""Cleaning of extracted entities, relations and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard

#: Noise types and least lengths by type (fixed values).
NOISE_TYPES = ("CARDINAL", "ORDINAL", "PERCENT", "QUANTITY")
LEAST_LENGTH = {"DATE": 8, "LANGUAGE": 3}
SYMMETRIC = ("RELATED_TO", "SIMILAR_TO")


def entity_reason(name: Column, kind: Column, stop_names: tuple[str, ...] = ()) -> Column:
    """Why an entity is dropped; null if it stays. The first reason counts."""
    bare = F.regexp_replace(name, r"(?i)^(the |a |an )", "")
    out = F.when(kind.isin(*NOISE_TYPES), "noise_type")
    for which, least in LEAST_LENGTH.items():
        out = out.when((kind == which) & (F.length(name) < least), "short_for_type")
    return out.when(F.length(bare) < 2, "too_short").when(F.length(bare) > 80, "too_long").when(F.lower(bare).isin(*stop_names or ("",)), "stop_name")


def dedup_relations(rows: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """One relation for each pair and type; symmetric types ignore the direction; the greatest weight stays."""
    a, b = F.lower(F.trim("source")), F.lower(F.trim("target"))
    turn = F.col("type").isin(*symmetric) & (a > b)
    keyed = rows.select(F.when(turn, b).otherwise(a).alias("a"), F.when(turn, a).otherwise(b).alias("b"), "type", "description", "weight")
    return keyed.groupBy("a", "b", "type").agg(
        F.max("weight").alias("weight"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("description")), "; ").alias("descriptions")
    )


def hygiene(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row: self loops, missing evidence, invalid types, and the score 100 (1 - issues / relations)."""
    loop = F.lower("source") == F.lower("target")
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(loop).alias("loops"), F.count_if(F.coalesce("evidence", F.lit("")) == "").alias("no_evidence"), F.count_if(~F.col("type").isin(*types)).alias("bad_type")
    )
    issues = F.col("loops") + F.col("no_evidence") + F.col("bad_type")
    return counts.withColumn("score", F.round(F.when(F.col("n") > 0, 100 * (1 - issues / F.col("n"))).otherwise(100.0), 4))


def is_numeric(cell: Column) -> Column:
    """Whether a cell is a number, with signs of thousands, currencies or percent around it."""
    return F.expr("try_cast('1' as double)").isNotNull() & F.rlike(F.regexp_replace(cell, r"[,\s$%]", ""), F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"))


def table_quality(cells: Column) -> dict[str, Column]:
    """Density, rectangularity, header plausibility, column type consistency and their weighted score."""
    flat = F.flatten(cells)
    density = F.when(F.size(flat) > 0, F.size(F.filter(flat, lambda c: F.trim(c) != "")) / F.size(flat)).otherwise(0.0)
    widths = F.size(F.array_distinct(F.transform(cells, lambda r: F.size(r))))
    rectangular = F.when(widths > 0, 1 / widths).otherwise(0.0)
    header, body = F.element_at(cells, 1), F.flatten(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))))
    share = lambda a, f: F.when(F.size(a) > 0, F.size(F.filter(a, f)) / F.size(a)).otherwise(0.0)
    head = 0.6 * share(header, lambda c: ~is_numeric(c)) + 0.4 * share(body, is_numeric)
    return {"density": density, "rectangular": rectangular, "header": head}


def grid_size(grid: Column) -> tuple[Column, Column]:
    """Rows of a grid (an array of rows) and the cells of its widest row."""
    return F.size(grid), F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def grid_agreement(a: Column, b: Column) -> Column:
    """0.3 x mean ratio of rows and of columns, 0.5 x Jaccard of the cells' texts, 0.2 x equal places of the first rows."""
    plain = lambda r: F.transform(r, lambda c: F.lower(F.trim(c)))
    (rows_a, cols_a), (rows_b, cols_b) = grid_size(a), grid_size(b)
    sizes = (F.least(rows_a, rows_b) / F.greatest(rows_a, rows_b) + F.least(cols_a, cols_b) / F.greatest(cols_a, cols_b)) / 2
    cells = lambda g: F.array_distinct(F.filter(plain(F.flatten(g)), lambda c: c != ""))
    head_a, head_b = plain(F.get(a, F.lit(0))), plain(F.get(b, F.lit(0)))
    same = F.size(F.filter(F.zip_with(head_a, head_b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    heads = F.coalesce(same / F.greatest(F.size(head_a), F.size(head_b)), F.lit(0.0))
    empty = (rows_a <= 0) | (rows_b <= 0) | (cols_a <= 0) | (cols_b <= 0)
    return F.when(F.coalesce(empty, F.lit(True)), 0.0).otherwise(0.3 * sizes + 0.5 * jaccard(cells(a), cells(b)) + 0.2 * heads)


def cross_validate(score: Column) -> Column:
    """Whether a table of middling quality is worth a second reading."""
    return score.between(0.5, 0.85)


def grade(score: Column) -> Column:
    return F.when(score >= 0.7, "ingest").when(score >= 0.5, "with_warning").otherwise("rejected")


def consistency(n: Column, orphans: Column, loose_chunks: Column, no_source: Column) -> Column:
    """1 - (1 oe + 0.3 oc + 0.5 ms) / n, not below 0."""
    return F.when(n > 0, F.greatest(F.lit(0.0), 1 - (orphans + 0.3 * loose_chunks + 0.5 * no_source) / n)).otherwise(F.lit(1.0))


def synthesis_quality(length: Column, cited: Column, contexts: Column) -> Column:
    """Points of an answer for its length, its citations and its contexts."""
    by_length = F.when(length > 500, 0.3).when(length > 200, 0.15).otherwise(0.0)
    by_citation = F.when(cited > 0, 0.2 + F.when(cited / F.greatest(contexts, F.lit(1)) > 0.3, 0.2).otherwise(0.0)).otherwise(0.0)
    return by_length + by_citation + F.when(contexts >= 10, 0.3).when(contexts >= 5, 0.15).otherwise(0.0)
