"""Updates of knowledge tables, bitemporal joins, explanations, exports and small models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph, similarity
from tessera.operators.analytics import ranks
from tessera.session import saved, small


# ---- time -------------------------------------------------------------------


def at_time(rows: DataFrame, t: Column, begin: str, end: str) -> DataFrame:
    """Rows that hold at an instant: begun, and open or ended later."""
    return rows.filter((F.col(begin) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def neighbours_at(left: DataFrame, relations: DataFrame, right: DataFrame, t: Column) -> DataFrame:
    """(src, dst) of relations that hold at an instant together with both ends (id); all with valid_from and valid_to."""
    own, a, b = [at_time(x, t, "valid_from", "valid_to") for x in (relations, left, right)]
    found = own.select("src", "dst").join(a.select(F.col("id").alias("src")), "src", "left_semi")
    return found.join(b.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def reverted(versions: DataFrame, key: str, version: int, now: Column, why: str, payload: list[str]) -> DataFrame:
    """Versions (key, version, valid_from, valid_to, payload) and one more for each key: the payload of ``version`` again.

    The open version ends now; keys without that version are the caller's to leave out.
    """
    last = versions.groupBy(key).agg(F.max("version").alias("_last"))
    closed = versions.join(last, key).withColumn("valid_to", F.when(F.col("version") == F.col("_last"), now).otherwise(F.col("valid_to")))
    closed = closed.select(key, "version", *payload, "valid_from", "valid_to", F.lit("").alias("reason"))
    old = versions.filter(F.col("version") == version).join(last, key)
    new = old.select(key, (F.col("_last") + 1).alias("version"), *payload, now.alias("valid_from"), F.lit(None).cast(versions.schema["valid_to"].dataType).alias("valid_to"), F.lit(f"{why} (reverted to version {version})").alias("reason"))
    return closed.unionByName(new)


# ---- updates ----------------------------------------------------------------


def merged(rows: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with ``fields`` of ``new`` where the key is known, and the new rows where it isn't."""
    other = new.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    kept = rows.join(other, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else c for c in rows.columns])
    return kept.unionByName(new.join(rows.select(key), key, "left_anti").select(*rows.columns))


def set_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows but those for which the condition is true."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (community, label) with the communities' new labels (community, new)."""
    return members.join(labels, "community", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def overridden(kind: Column, overrides: dict[str, str], synonyms: dict[str, str]) -> Column:
    """A relation's type: upper case with ``_``, then a person's override, else a synonym, else as it is."""
    name = F.translate(F.upper(F.trim(kind)), " -", "__")
    look = lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), name) if t else F.lit(None).cast("string")
    return F.coalesce(look(overrides), look(synonyms), name)


def without_artifacts(relations: DataFrame, source: str, target: str, names: tuple[str, ...]) -> DataFrame:
    """Relations but those of which both ends are blocked names."""
    return relations.filter(~(F.coalesce(F.col(source).isin(*names), F.lit(False)) & F.coalesce(F.col(target).isin(*names), F.lit(False))))


def payload(rows: DataFrame, metadata: str, fields: list[str], namespace: str = "default") -> DataFrame:
    """Chunks as flat rows: metadata (a map) overrides ``fields``, a missing namespace is the default one."""
    return rows.withColumns({c: F.coalesce(F.col(metadata)[c], F.col(c)) for c in fields}).withColumn("namespace", F.coalesce("namespace", F.lit(namespace)))


def archived(rows: DataFrame, key: str, rested: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of groups for which ``rested`` (an aggregate) is true, and the others."""
    cold = rows.groupBy(key).agg(rested.alias("_cold")).filter("_cold").select(key)
    return rows.join(cold, key, "left_semi"), rows.join(cold, key, "left_anti")


def dealt(rows: DataFrame, key: str, first: float, last: float, seed: int) -> DataFrame:
    """(key, difficulty): in a hashed order the first share is D1, the last one D3, the rest D2."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ranked = ranks(rows.withColumns({"_g": F.lit(1), "_o": order}), ["_g"], "_o", key)
    kind = F.when(F.col("_r") <= F.floor(F.col("_n") * first), "D1").when(F.col("_r") <= F.col("_n") - F.floor(F.col("_n") * last), "D2").otherwise("D3")
    return ranked.select(key, kind.alias("difficulty"))


# ---- answers ----------------------------------------------------------------


def answer_metrics(judged: DataFrame, group: str, attributable: Column, supported: Column) -> DataFrame:
    """Of judged statements: context recall and faithfulness (1 without a judged one), hallucination (0 without), flagged above 0.1."""
    wrong = F.avg((~supported).cast("double"))
    return judged.groupBy(group).agg(
        F.round(F.coalesce(F.avg(attributable.cast("double")), F.lit(1.0)), 6).alias("context_recall"),
        F.round(F.coalesce(F.avg(supported.cast("double")), F.lit(1.0)), 6).alias("faithfulness"),
        F.round(F.coalesce(wrong, F.lit(0.0)), 6).alias("hallucination"),
        (F.coalesce(wrong, F.lit(0.0)) > 0.1).alias("flagged"),
    )


def attributions(chunks: DataFrame, relevance: Column, reason: Column, chars: int = 200) -> DataFrame:
    return chunks.select("doc_id", "source", F.substring("text", 1, chars).alias("excerpt"), F.coalesce(relevance, F.lit(0)).alias("relevance"), reason.alias("reason"))


def consented(required: Column, granted: Column) -> Column:
    """Whether every required category is granted."""
    return F.size(F.array_except(required, granted)) == 0


#: Third-person pronouns (fixed values).
PRONOUNS = "He|She|It|They|he|she|it|they"


def resolved(text: Column) -> Column:
    """Pronouns that follow a capitalised word in the same or the last sentence give way to it, from left to right.

    One pattern that takes any capitalised word for a name; ``operators.coreference`` scores entities.
    """
    name = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
    return F.regexp_replace(text, name + r"((?:(?![A-Z][a-z])[^.!?])*[.!?]?\s+)(?:" + PRONOUNS + r")\b", "$1$2$1")


# ---- graphs -----------------------------------------------------------------


def drawn_nodes(nodes: DataFrame) -> DataFrame:
    """(format, item): nodes (id, name, type) as JSON for three drawing libraries; kinds are numbered in their order."""
    kinds = nodes.select("type").distinct().withColumn("group", F.row_number().over(Window.orderBy("type")))  # a table of kinds
    rows = nodes.join(small(kinds), "type")
    d3 = F.struct("id", F.col("name").alias("label"), "type", "group")
    cyto = F.struct(F.struct("id", F.col("name").alias("label"), "type").alias("data"))
    vis = F.struct("id", F.col("name").alias("label"), F.col("name").alias("title"), F.col("type").alias("group"))
    return _drawn(rows, {"d3": d3, "cytoscape": cyto, "vis": vis})


def drawn_edges(edges: DataFrame) -> DataFrame:
    """(format, item): edges (id, source, target, type) as JSON."""
    d3 = F.struct("source", "target", "type", F.lit(1).alias("value"))
    cyto = F.struct(F.struct(F.concat(F.lit("edge_"), "id").alias("id"), "source", "target", F.col("type").alias("label")).alias("data"))
    vis = F.struct("id", F.col("source").alias("from"), F.col("target").alias("to"), F.col("type").alias("label"), F.col("type").alias("title"))
    return _drawn(edges, {"d3": d3, "cytoscape": cyto, "vis": vis})


def _drawn(rows: DataFrame, shapes: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("format"), F.to_json(shape).alias("item")) for name, shape in shapes.items()]))
    return rows.select(each.alias("x")).select("x.*")


@dataclass
class Templates:
    """Stock questions on undirected edges (src, dst, both directions) and nodes (node, name, kind)."""

    edges: DataFrame
    nodes: DataFrame

    def orphans(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("src").alias("node")), "node", "left_anti")

    def highly_connected(self, least: int) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).filter(F.col("degree") >= least)

    def degree_distribution(self) -> DataFrame:
        return self.edges.groupBy("src").count().groupBy(F.col("count").alias("degree")).agg(F.count("*").alias("n"))

    def neighbours(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node)

    def by_kind(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind)

    def search(self, part: str) -> DataFrame:
        return self.nodes.filter(F.lower("name").contains(part.lower()))

    def subgraph(self, node: str) -> DataFrame:
        """Edges among a node and its neighbours."""
        inside = self.neighbours(node).select(F.col("dst").alias("node")).unionByName(self.edges.sparkSession.range(1).select(F.lit(node).alias("node"))).distinct()
        found = self.edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
        return found.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")

    def path(self, start: str, goal: str) -> DataFrame:
        return graph.shortest_path(self.edges, start, goal)


def batch(queries: dict[str, DataFrame]) -> DataFrame:
    """(template, n): the sizes of many answers in one plan, which Spark runs side by side."""
    out = None
    for name, rows in queries.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("template"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def section_edges(sections: DataFrame, document: str, id_: str, level: str) -> DataFrame:
    """(src, dst, kind): FOLLOWS to the next section, PARENT_OF from the nearest earlier one of the level above (two levels)."""
    w = Window.partitionBy(document).orderBy(id_)
    rows = sections.withColumn("_next", F.lead(id_).over(w)).withColumn("_top", F.last(F.when(F.col(level) == 1, F.col(id_)), True).over(w))
    follows = rows.filter("_next IS NOT NULL").select(F.col(id_).alias("src"), F.col("_next").alias("dst"), F.lit("FOLLOWS").alias("kind"))
    parent = rows.filter((F.col(level) > 1) & F.col("_top").isNotNull()).select(F.col("_top").alias("src"), F.col(id_).alias("dst"), F.lit("PARENT_OF").alias("kind"))
    return follows.unionByName(parent)


def clusters(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(vec_id, cluster, silhouette) by KMeans; up to two vectors are one cluster of silhouette 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = rows.count()
    if n <= 2:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(1.0).alias("silhouette"))
    found = KMeans(k=max(2, min(k, n)), seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
    score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(found) if found.select("cluster").distinct().count() > 1 else 1.0
    return found.select("vec_id", "cluster", F.lit(score).alias("silhouette"))


def spherical(points: DataFrame, k: int, rounds: int = 3) -> DataFrame:
    """(id, cluster, score) of points (id, embedding): clusters by cosine to mean vectors, from the ``k`` least ids.

    Each round every point goes to its nearest centre (the first on ties, six digits) and
    centres become means; one without points stays. Batches of points meet the centres, k
    rows, as a matrix; means are pre-aggregated by component. Vectors without a direction,
    or of another size than the first one, are in no cluster.
    """
    own = similarity.usable(points).select("id", "v")
    first = own.orderBy("id").limit(k).collect()
    if not first:
        return own.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("score"))
    centres = np.array([r["v"] for r in first if len(r["v"]) == len(first[0]["v"])])
    own = saved(own.filter(F.size("v") == centres.shape[1]))

    def assigned(centres: np.ndarray) -> DataFrame:
        size = np.sqrt((centres * centres).sum(axis=1))

        def run(batches):
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                score = np.round(x @ centres.T / (np.sqrt((x * x).sum(axis=1))[:, None] * np.where(size > 0, size, np.inf)), 6)
                at = score.argmax(axis=1) if len(x) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(score[np.arange(len(x)), at])], names=["id", "v", "cluster", "score"])

        return own.mapInArrow(run, "id long, v array<double>, cluster int, score double")

    for _ in range(rounds):
        means = assigned(centres).select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
        centres = centres.copy()
        for r in means.collect():  # k centres' components
            centres[r["cluster"], r["i"]] = r["m"]
    return assigned(centres).select("id", "cluster", "score")
