"""Entity resolution, section chunking and other order-dependent folds, one document or block a group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import entity_id
from tessera.operators import graph, similarity
from tessera.session import saved

#: Section chunks: alone above, merged up to (tokens).
ALONE, MOST = 1200, 1800


def section_chunks(sections: DataFrame, alone: int = ALONE, most: int = MOST) -> DataFrame:
    """Sections (doc_id, seq, heading, text, tokens) to chunks: long ones alone, others merged while they fit.

    A greedy fold in section order. Each task passes its documents' sorted sections in batches
    and keeps only the open chunk, so that no document is a group or frame of its own.
    """
    kind = dict(sections.dtypes)["doc_id"]

    def chunk(doc, number, rows):
        return doc, number, "\n".join(r.text for r in rows), [r.heading for r in rows], int(sum(r.tokens for r in rows))

    def fold(frames):
        doc, number, open_, size, begun = None, 0, [], 0, False
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = None if pd.isna(row.doc_id) else row.doc_id
                other = not begun or own != doc
                if open_ and (other or row.tokens > alone or size + row.tokens > most):
                    out.append(chunk(doc, number, open_))
                    number, open_, size = number + 1, [], 0
                if other:
                    doc, number, begun = own, 0, True
                if row.tokens > alone:
                    out.append(chunk(doc, number, [row]))
                    number += 1
                else:
                    open_.append(row)
                    size += row.tokens
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "text", "headings", "tokens"])
        if open_:
            yield pd.DataFrame([chunk(doc, number, open_)], columns=["doc_id", "chunk_no", "text", "headings", "tokens"])

    rows = sections.select("doc_id", "seq", "heading", "text", "tokens").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return rows.mapInPandas(fold, f"doc_id {kind}, chunk_no int, text string, headings array<string>, tokens long")


def same_entities(names: DataFrame, edits: int = 2, least: int = 5, inside: int = 6, cosine: float = 0.93) -> DataFrame:
    """(id, canonical): names equal after normalising, within few edits, contained, or with near embeddings, joined transitively.

    ``names``: id, kind, name and, for the last rule, embedding (of an exact name the
    least id's counts). Only names of one kind meet. The candidates are complete for the
    rules: of a name cut to ``edits`` + 1 pieces one survives that many edits at nearly
    its place, and a name inside another shares every run of ``inside`` characters with
    it, so it is looked up by its rarest one. The least id of a component is canonical.
    """
    rows = names.select("id", "kind", entity_id(F.col("name")).alias("key"), *(["embedding"] if "embedding" in names.columns else []))
    exact = saved(rows.groupBy("kind", "key").agg(F.min("id").alias("rep")))
    links = _near_names(exact, edits, least).unionByName(_inside_names(exact, inside))
    if "embedding" in rows.columns:
        vectors = rows.join(exact.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "kind", "embedding")
        links = links.unionByName(_near_vectors(vectors, cosine))
    comp = graph.components(links.select(F.col("rep").alias("src"), F.col("rep2").alias("dst")).distinct())
    named = exact.join(comp, F.col("rep") == F.col("node"), "left").select("kind", "key", F.coalesce("component", "rep").alias("canonical"))
    return rows.join(named, ["kind", "key"]).select("id", "canonical")


def _near_names(exact: DataFrame, edits: int, least: int) -> DataFrame:
    """Pairs (rep, rep2) of names of ``least`` characters or more within ``edits``."""
    own = exact.filter(F.length("key") >= least).withColumn("n", F.length("key"))
    k = F.explode(F.sequence(F.lit(0), F.lit(edits)))
    begin = lambda n, k: F.floor(n * k / (edits + 1)).cast("int")
    piece = lambda n, k, shift: F.substring("key", begin(n, k) + shift + 1, begin(n, k + 1) - begin(n, k))
    one = own.withColumn("k", k).select("kind", "key", "rep", "n", "k", piece(F.col("n"), F.col("k"), F.lit(0)).alias("piece"))
    # the other name asks for the pieces of every length and place that the edits allow
    two = own.withColumn("k", k).withColumn("m", F.explode(F.sequence(F.col("n") - edits, F.col("n") + edits))).filter(F.col("m") >= least)
    two = two.withColumn("shift", F.explode(F.sequence(F.lit(-edits), F.lit(edits)))).filter(begin(F.col("m"), F.col("k")) + F.col("shift") >= 0)
    two = two.select("kind", F.col("key").alias("other"), F.col("rep").alias("rep2"), F.col("m").alias("n"), "k", piece(F.col("m"), F.col("k"), F.col("shift")).alias("piece")).distinct()
    met = one.join(two, ["kind", "n", "k", "piece"]).filter("rep <> rep2").select("key", "other", "rep", "rep2").distinct()
    return met.filter(F.levenshtein("key", "other", edits) >= 0).select("rep", "rep2")


def _inside_names(exact: DataFrame, inside: int) -> DataFrame:
    """Pairs (rep, rep2) of names of ``inside`` characters or more of which the first holds the second."""
    own = exact.filter(F.length("key") >= inside)
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - inside + 1), lambda i: F.substring(F.col("key"), i, F.lit(inside)))))
    every = own.select("kind", "key", "rep", grams.alias("gram"))
    counts = every.groupBy("kind", "gram").agg(F.count("*").alias("c"))
    rare = every.join(counts, ["kind", "gram"]).groupBy("kind", F.col("key").alias("other"), F.col("rep").alias("rep2")).agg(F.min(F.struct("c", "gram"))["gram"].alias("gram"))
    return every.join(rare, ["kind", "gram"]).filter((F.col("rep") != F.col("rep2")) & F.col("key").contains(F.col("other"))).select("rep", "rep2")


def _near_vectors(rows: DataFrame, cosine: float) -> DataFrame:
    """Pairs (rep, rep2) of one kind whose embeddings are near: equal ones by a digest, others by an exact similarity join."""
    numbered = saved(rows.withColumn("num", F.monotonically_increasing_id()))
    members, points = similarity.distinct_vectors(numbered.select(F.col("num").alias("id"), F.col("kind").alias("scope"), "embedding"))
    links = similarity.near_pairs(points, cosine).select("a", "b").unionByName(members.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    ids = numbered.select("num", "id")
    links = links.join(ids.withColumnsRenamed({"num": "a", "id": "rep"}), "a").join(ids.withColumnsRenamed({"num": "b", "id": "rep2"}), "b")
    return links.select("rep", "rep2")


def remap(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations (source, target, ...) with both ends replaced by ``mapping`` (name, canonical)."""
    low = mapping.select(F.lower(F.trim("name")).alias("k"), "canonical")
    out = relations
    for end in ("source", "target"):
        other = low.withColumnsRenamed({"k": f"_{end}", "canonical": f"_{end}_c"})
        out = out.join(other, F.lower(F.trim(F.col(end))) == F.col(f"_{end}"), "left").withColumn(end, F.coalesce(f"_{end}_c", end)).drop(f"_{end}", f"_{end}_c")
    return out


def adaptive_rerank(rows: DataFrame, profiles: DataFrame, now: str, k: int) -> DataFrame:
    """w_s semantic + w_k keyword + w_r recency with the intent's weights; recency is exp(-days / 180), a half if missing."""
    days = F.datediff(F.lit(now).cast("date"), F.col("created_at"))
    recency = F.coalesce(F.exp(-days / 180.0), F.lit(0.5))
    scored = rows.join(F.broadcast(profiles), "intent").withColumn("score", F.round(F.col("ws") * F.col("semantic") + F.col("wk") * F.col("keyword") + F.col("wr") * recency, 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def canonical_records(mentions: DataFrame) -> DataFrame:
    """One row for each canonical entity of mentions (canonical, place, form, description, chunk, confidence).

    In the order of ``place`` (unique): the first form, numbers of different forms, descriptions
    and chunks, mentions, the first place, and the running confidence. With k different forms
    so far a mention's confidence x makes c to (c (k - 1) + x) / k, and to x while there is one form;
    unrolled, that is the sum of x / k times all later (k - 1) / k.
    """
    order = Window.partitionBy("canonical").orderBy("place")
    first = F.min("place").over(Window.partitionBy("canonical", "form")) == F.col("place")
    rows = mentions.withColumn("_fresh", first.cast("int"))
    rows = rows.withColumn("_k", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # what is later is read backwards: a frame that reaches to the end would be summed anew for each row
    later = Window.partitionBy("canonical").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    decay = F.sum(F.log((F.col("_k") - 1) / F.greatest(F.col("_k"), F.lit(2)) + F.when(F.col("_k") == 1, 1.0).otherwise(0.0))).over(later)
    restarts = F.sum(F.when(F.col("_k") == 1, 1).otherwise(0)).over(later)
    weight = F.when(F.coalesce(restarts, F.lit(0)) > 0, 0.0).otherwise(F.exp(F.coalesce(decay, F.lit(0.0))) / F.col("_k"))
    rows = rows.withColumn("_w", weight * F.col("confidence"))
    return rows.groupBy("canonical").agg(
        F.min_by("form", "place").alias("primary_name"),
        F.count_distinct("form").alias("n_forms"),
        F.count_distinct("description").alias("n_descriptions"),
        F.count_distinct("chunk").alias("n_chunks"),
        F.count("*").alias("n"),
        F.min("place").alias("first"),
        F.sum("_w").alias("confidence"),
    )
