"""The graph of documents' sections: order, hierarchy, references and similarity, and its communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import communities, similarity

LEVELS = 6
#: Weights of the kinds of edges for community detection, beside a cosine for SIMILAR_TO.
WEIGHTS = {"PARENT_OF": 1.0, "FOLLOWS": 0.5, "REFERENCES": 0.8}


def follows(sections: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): each section (id, doc, seq, level, heading, text) to the next one of its document."""
    order = Window.partitionBy("doc").orderBy("seq")
    rows = sections.select(F.col("id").alias("src"), F.lead("id").over(order).alias("dst")).filter("dst IS NOT NULL")
    return rows.select("src", "dst", F.lit("FOLLOWS").alias("kind"), F.lit(WEIGHTS["FOLLOWS"]).alias("weight"))


def parents(sections: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): to each section from the nearest one before it that has a lower level."""
    before = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("seq", "id"))).over(before).alias(f"_l{k}") for k in range(1, LEVELS)]
    rows = sections.select("id", "level", *last)
    nearest = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, LEVELS)])
    rows = rows.select(nearest["id"].alias("src"), F.col("id").alias("dst")).filter("src IS NOT NULL")
    return rows.select("src", "dst", F.lit("PARENT_OF").alias("kind"), F.lit(WEIGHTS["PARENT_OF"]).alias("weight"))


def _pairs_of_words(text):
    # words are bound to a lambda's variable, so that the text is split once
    def pairs(words):
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def references(sections: DataFrame, least: int = 8) -> DataFrame:
    """(src, dst, kind, weight): a section names another one of its document by the first two words of its heading.

    The two words stand side by side and have ``least`` characters with their space, so that
    short phrases name nothing. Each section gets the phrases that its document's headings
    name, so that of its own only these go on to meet them by equality.
    """
    first = F.array_join(F.slice(F.filter(F.split(F.lower("heading"), r"[^\p{L}\p{N}]+", 4), lambda w: w != ""), 1, 2), " ")
    named = sections.select("doc", F.col("id").alias("dst"), first.alias("phrase")).filter((F.length("phrase") >= least) & F.col("phrase").contains(" "))
    names = named.groupBy("doc").agg(F.collect_set("phrase").alias("_named"))
    said = sections.select("doc", F.col("id").alias("src"), "text").join(names, "doc")
    said = said.select("doc", "src", F.explode(F.array_intersect(_pairs_of_words(F.col("text")), "_named")).alias("phrase"))
    rows = said.join(named, ["doc", "phrase"]).filter("src <> dst").select("src", "dst").distinct()
    return rows.select("src", "dst", F.lit("REFERENCES").alias("kind"), F.lit(WEIGHTS["REFERENCES"]).alias("weight"))


def similar(points: DataFrame, least: float = 0.8) -> DataFrame:
    """(src, dst, kind, weight): sections (id, embedding[, scope]) at a cosine of ``least`` or nearer, once a pair."""
    near = similarity.near_pairs(points, least)
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SIMILAR_TO").alias("kind"), F.round("score", 6).alias("weight"))


def section_graph(sections: DataFrame, points: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """All edges of sections; ``points`` holds the embeddings of those that have one."""
    edges = parents(sections).unionByName(follows(sections)).unionByName(references(sections))
    return edges.unionByName(similar(points, least)) if points is not None else edges


def section_communities(edges: DataFrame, min_size: int = 2, resolution: float = 1.0) -> DataFrame:
    """(node, community) of sections by modularity over all kinds of edges."""
    return communities.louvain(edges.select("src", "dst", "weight"), resolution, min_size)
