"""Graph patterns as joins: nodes, relationships in three directions, and walks of bounded length.

A ``Pattern`` binds variables step by step; every step is a join of the rows so far with
the edges, so filters given first narrow all that follows. No edge is used twice in a
match, neither by two relationships nor inside a walk. Bounds are unrolled to one join
a hop, as a walk may not end by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import saved

DIRECTIONS = ("->", "<-", "-")
#: Walks that one task counts, edges of a list.
WALKS, LISTED = 2_000_000, 4_096


class Pattern:
    """Matches over nodes (id, ...) and edges (id, src, dst[, type, ...]); every method gives a new pattern.

    Rows have a column of node ids for each variable, ``<edge>`` and ``<edge>_hops`` for each
    named relationship (an array of the walk's edge ids, and its length), and ``_used``.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, rows: DataFrame | None = None):
        self.nodes, self.edges, self.rows = nodes, edges, rows

    def _with(self, rows: DataFrame) -> Pattern:
        return Pattern(self.nodes, self.edges, rows)

    @property
    def _edge_kind(self) -> str:
        return self.edges.schema["id"].dataType.simpleString()

    def node(self, name: str, where: Column | str | None = None) -> Pattern:
        """Bind the first variable, or narrow one that is bound, to nodes that fulfil ``where`` (of node columns)."""
        fits = (self.nodes.filter(where) if where is not None else self.nodes).select(F.col("id").alias(name))
        if self.rows is None:
            return self._with(fits.withColumn("_used", F.array().cast(f"array<{self._edge_kind}>")))
        if name not in self.rows.columns:
            raise ValueError(f"{name} is not bound: reach it by a relationship")
        return self._with(self.rows.join(fits, name, "left_semi"))

    def _ways(self, kind: str | None, direction: str) -> DataFrame:
        if direction not in DIRECTIONS:
            raise ValueError(f"a direction is one of {DIRECTIONS}")
        edges = self.edges.filter(F.col("type") == kind) if kind is not None else self.edges
        along = edges.select(F.col("id").alias("_e"), F.col("src").alias("_a"), F.col("dst").alias("_b"))
        back = along.select("_e", F.col("_b").alias("_a"), F.col("_a").alias("_b"))
        if direction == "-":  # a loop is one way, not two
            return along.unionByName(back.filter("NOT _a <=> _b"))
        return along if direction == "->" else back

    def relationship(self, source: str, kind: str | None = None, target: str | None = None, direction: str = "->", min_hops: int = 1, max_hops: int | None = None, name: str | None = None) -> Pattern:
        """Walk from a bound variable by edges of a type; ``max_hops`` (as many as ``min_hops`` where not given) is a bound.

        A ``target`` that is bound must be where the walk ends; zero hops end where they begin.
        """
        most = min_hops if max_hops is None else max_hops
        if self.rows is None or source not in self.rows.columns:
            raise ValueError(f"{source} is not bound")
        if not 0 <= min_hops <= most:
            raise ValueError("hops are bounded: 0 <= min_hops <= max_hops")
        ways, target = self._ways(kind, direction), target or "_end"
        bound = target in self.rows.columns
        step = self.rows.withColumns({"_at": F.col(source), "_walk": F.array().cast(f"array<{self._edge_kind}>")})
        found = step if min_hops == 0 else None
        for hop in range(1, most + 1):
            step = step.join(ways, F.col("_at") == F.col("_a")).filter(~F.array_contains("_used", F.col("_e")))
            step = step.withColumns({"_at": F.col("_b"), "_used": F.array_append("_used", F.col("_e")), "_walk": F.array_append("_walk", F.col("_e"))}).drop("_e", "_a", "_b")
            if hop >= min_hops:
                found = step if found is None else found.unionByName(step)
        found = found.filter(F.col("_at") == F.col(target)).drop("_at") if bound else found.withColumnRenamed("_at", target)
        if name:
            found = found.withColumns({name: F.col("_walk"), f"{name}_hops": F.size("_walk")})
        return self._with(found.drop("_walk", *([] if target != "_end" else ["_end"])))

    def walk_counts(self, source: str, kind: str | None = None, direction: str = "->", min_hops: int = 1, max_hops: int | None = None) -> DataFrame:
        """(source, end, hops, n): how many walks of each length, as of ``relationship``, lead from a bound node to an end."""
        most = min_hops if max_hops is None else max_hops
        if self.rows is None or source not in self.rows.columns:
            raise ValueError(f"{source} is not bound")
        if not 0 <= min_hops <= most:
            raise ValueError("hops are bounded: 0 <= min_hops <= max_hops")
        ways = saved(self._ways(kind, direction))
        step, found = saved(self.rows.select(source, F.col(source).alias("_at"), "_used")), []
        for hop in range(most + 1):
            if hop == most and hop:
                counts = _last_counts(step, ways, source)
            else:
                if hop:
                    step = step.join(ways, F.col("_at") == F.col("_a")).filter(~F.array_contains("_used", F.col("_e")))
                    step = saved(step.select(source, F.col("_b").alias("_at"), F.array_append("_used", F.col("_e")).alias("_used")))
                counts = step.groupBy(source, F.col("_at").alias("end")).agg(F.count("*").alias("n"))
            if hop >= min_hops:
                found.append(counts.select(source, "end", F.lit(hop).alias("hops"), "n"))
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return out

    def properties(self, name: str, *columns: str) -> Pattern:
        """Add columns of a variable's node as ``<name>_<column>``; null where the id has no node."""
        own = self.nodes.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        return self._with(self.rows.join(own, name, "left"))

    def where(self, condition: Column | str) -> Pattern:
        return self._with(self.rows.filter(condition))

    def matches(self, *columns: str, distinct: bool = False) -> DataFrame:
        """The rows of all matches, or columns of them."""
        rows = self.rows.drop("_used") if not columns else self.rows.select(*columns)
        return rows.distinct() if distinct else rows

    def shortest(self, source: str, target: str, hops: str) -> DataFrame:
        """(source, target, hops): the least length of a named walk between each pair of ends."""
        return self.rows.groupBy(source, target).agg(F.min(f"{hops}_hops").alias("hops"))


def _last_counts(step: DataFrame, ways: DataFrame, source: str) -> DataFrame:
    """(source, end, n): walks (source, _at, _used) and one edge more (_e, _a, _b), counted.

    The walks through a node are the product of those to it and its edges, so many of them are
    neither shuffled nor met by node: sources are dealt to groups of about ``WALKS`` walks, each
    gets a node's edges once, as lists, and counts its own.
    """
    ends, degree = step.groupBy("_at").agg(F.count("*").alias("_n")), ways.groupBy("_a").agg(F.count("*").alias("_d"))
    total = ends.join(degree, F.col("_at") == F.col("_a")).agg(F.sum(F.col("_n") * F.col("_d"))).first()[0] or 0
    if total <= WALKS:
        met = step.join(ways, F.col("_at") == F.col("_a")).filter(~F.array_contains("_used", F.col("_e")))
        return met.groupBy(source, F.col("_b").alias("end")).agg(F.count("*").alias("n"))
    groups = -(-total // WALKS)
    own = step.withColumn("_g", F.pmod(F.xxhash64(source), F.lit(groups)).cast("int"))
    own = own.groupBy("_g", "_at").agg(F.collect_list(F.struct(F.col(source).alias("s"), F.col("_used").alias("u"))).alias("_own"))
    piece = F.pmod(F.xxhash64("_e"), F.ceil(F.col("_d") / LISTED))
    lists = ways.join(degree, "_a").groupBy("_a", piece.alias("_p")).agg(F.collect_list(F.struct(F.col("_e").alias("e"), F.col("_b").alias("b"))).alias("_ways"))
    met = own.join(lists, F.col("_at") == F.col("_a")).select("_g", "_own", "_ways").repartitionById(groups, "_g")
    met = met.select("_g", F.explode("_own").alias("_o"), "_ways").select("_g", F.col("_o.s").alias(source), F.col("_o.u").alias("_u"), F.explode("_ways").alias("_w"))
    met = met.filter(~F.array_contains("_u", F.col("_w.e")))
    return met.groupBy("_g", source, F.col("_w.b").alias("end")).agg(F.count("*").alias("n")).drop("_g")


def pattern(nodes: DataFrame, edges: DataFrame) -> Pattern:
    return Pattern(nodes, edges)
