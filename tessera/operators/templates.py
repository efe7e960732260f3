"""Stock questions on a graph of nodes (id, label, name, ...) and edges (id, src, dst, type, ...), answered as rows.

Each is a few joins on patterns; limits are part of the question and follow a total order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.patterns import pattern


@dataclass
class Templates:
    nodes: DataFrame
    edges: DataFrame

    def lookup(self, name: str) -> DataFrame:
        return self.nodes.filter(F.col("name") == name)

    def by_type(self, label: str, limit: int = 50) -> DataFrame:
        return self.nodes.filter(F.col("label") == label).orderBy("name", "id").limit(limit)

    def search(self, text: str, limit: int = 5) -> DataFrame:
        return self.nodes.filter(F.lower("name").contains(text.lower())).orderBy("name", "id").limit(limit)

    def neighbours(self, node: str, depth: int = 1, kind: str | None = None) -> DataFrame:
        """(b, hops): what is within ``depth`` steps of a node, with the least number of them."""
        found = pattern(self.nodes, self.edges).node("a", F.col("id") == node).relationship("a", kind, "b", "-", 1, depth, name="r")
        return found.shortest("a", "b", "r").filter("a <> b").select("b", "hops")

    def relationships(self, node: str, direction: str = "-", kind: str | None = None) -> DataFrame:
        """(b, edge): a node's relationships in one or any direction."""
        found = pattern(self.nodes, self.edges).node("a", F.col("id") == node).relationship("a", kind, "b", direction, name="r")
        return found.rows.select("b", F.get("r", F.lit(0)).alias("edge"))

    def relationships_by_type(self, kind: str, limit: int = 100) -> DataFrame:
        return self.edges.filter(F.col("type") == kind).orderBy("src", "dst", "id").limit(limit)

    def subgraph(self, seeds: list[str], depth: int = 2) -> DataFrame:
        """Edges among all nodes within ``depth`` steps of the seeds (ids or names)."""
        start = F.col("id").isin(seeds) | F.col("name").isin(seeds)
        inside = pattern(self.nodes, self.edges).node("a", start).relationship("a", None, "b", "-", 0, depth).rows.select("b").distinct()
        rows = self.edges.join(inside.withColumnRenamed("b", "src"), "src", "left_semi")
        return rows.join(inside.withColumnRenamed("b", "dst"), "dst", "left_semi")

    def path(self, source: str, target: str, most: int = 4) -> DataFrame:
        """(hops): the least number of steps between two nodes, no row where it is more than ``most``."""
        found = pattern(self.nodes, self.edges).node("a", F.col("id") == source).relationship("a", None, "b", "-", 0, most, name="r")
        return found.node("b", F.col("id") == target).shortest("a", "b", "r").select("hops")

    def statistics(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count("*").alias("n"))

    def relationship_statistics(self) -> DataFrame:
        return self.edges.groupBy("type").agg(F.count("*").alias("n"))

    def degrees(self) -> DataFrame:
        """(id, degree): edges of each node, a loop counted once."""
        ends = self.edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    def orphans(self) -> DataFrame:
        return self.nodes.join(self.degrees(), "id", "left_anti")

    def highly_connected(self, least: int = 10) -> DataFrame:
        return self.degrees().filter(F.col("degree") >= least)

    def degree_distribution(self) -> DataFrame:
        return self.degrees().groupBy("degree").agg(F.count("*").alias("n"))

    def recent(self, since: str, column: str = "created_at") -> DataFrame:
        return self.nodes.filter(F.col(column) >= F.lit(since).cast("timestamp"))

    def similar(self, node: str, limit: int = 10) -> DataFrame:
        """(b, common): nodes of the same label that share most neighbours."""
        same = self.nodes.filter(F.col("id") == node).select("label")
        found = pattern(self.nodes, self.edges).node("a", F.col("id") == node).relationship("a", None, "via", "-").relationship("via", None, "b", "-")
        counts = found.rows.filter("a <> b").groupBy("b").agg(F.count_distinct("via").alias("common"))
        own = self.nodes.join(F.broadcast(same), "label", "left_semi").select(F.col("id").alias("b"))  # one row
        return counts.join(own, "b", "left_semi").orderBy(F.desc("common"), "b").limit(limit)
