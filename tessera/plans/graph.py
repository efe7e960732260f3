"""Graph queries on the supplier-part graph of the order lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.plans.registry import query
from tessera.session import stored
from tessera.sources.tables import load, supply_edges, supply_name, supply_numbers

_SUPPLY = "sup AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"
_UND = "und AS (SELECT src, dst FROM {0} WHERE src <> dst UNION SELECT dst, src FROM {0} WHERE src <> dst)"


@query(f"WITH {_SUPPLY}, {_UND.format('sup')} SELECT src AS node, count(*) AS degree FROM und GROUP BY src")
def degree_centrality(spark, d):
    return g.degree(supply_edges(spark, d))


@query(f"""WITH {_SUPPLY}, n AS (SELECT count(*) AS n_nodes FROM (SELECT src FROM sup UNION SELECT dst FROM sup)), e AS (SELECT count(*) AS n_edges FROM sup)
SELECT n_nodes, n_edges, round(2 * n_edges / n_nodes::DOUBLE, 6) AS avg_degree, round(n_edges / (n_nodes * (n_nodes - 1) / 2.0::DOUBLE), 6) AS density FROM n, e""")
def graph_stats(spark, d):
    return g.statistics(supply_edges(spark, d))


_BOTH = f"{_SUPPLY}, {_UND.format('sup')}"


def both_ways(spark, d):
    """The supply graph with every edge in both directions."""
    return g.undirected(supply_edges(spark, d))


def seeds(spark, d, n):
    """The suppliers with the least ``n`` keys."""
    return load(spark, d, "supplier").filter(F.col("s_suppkey") < n).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))


_PARTNERS = f"{_SUPPLY}, und AS (SELECT DISTINCT x.src AS src, y.src AS dst FROM sup x JOIN sup y ON x.dst = y.dst AND x.src <> y.src)"


def in_rounds(first, step, last, rounds, edges=_BOTH):
    """A SQL query of common table expressions r0, r1, ... each made from the one before by ``step``."""
    steps = ", ".join(f"r{k} AS ({step.format(r=f'r{k - 1}')})" for k in range(1, rounds + 1))
    return f"WITH {edges}, nodes AS (SELECT DISTINCT src AS node FROM und), r0 AS ({first}), {steps} {last.format(r=f'r{rounds}')}"


@query(f"""WITH {_BOTH}, w0 AS (SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_suppkey < 5),
w1 AS (SELECT DISTINCT seed, dst AS node, 1 AS hop FROM w0 JOIN und ON node = src), w2 AS (SELECT DISTINCT seed, dst AS node, 2 AS hop FROM w1 JOIN und ON node = src)
SELECT seed, node, min(hop) AS hop FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY seed, node""")
def k_hop(spark, d):
    """Least steps to every node within two, from five suppliers."""
    return g.k_hop(supply_edges(spark, d), seeds(spark, d, 5), 2)


@query(in_rounds("SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes",
    "SELECT dst AS node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * sum(rank / n_out) AS rank FROM und JOIN {r} ON src = {r}.node JOIN (SELECT src AS s, count(*) AS n_out FROM und GROUP BY src) ON s = src GROUP BY dst",
    "SELECT node, round(rank, 9) AS rank FROM {r}", 10))
def pagerank(spark, d):
    """Ten rounds on the supply graph."""
    return g.pagerank(g.undirected(supply_numbers(spark, d)), rounds=10).select(supply_name("node").alias("node"), F.round("rank", 9).alias("rank"))


@query(in_rounds("SELECT node, node AS component FROM nodes",
    "SELECT src AS node, least(any_value(a.component), min(b.component)) AS component FROM und JOIN {r} a ON a.node = src JOIN {r} b ON b.node = dst GROUP BY src",
    "SELECT node, component FROM {r}", 8))
def components(spark, d):
    """Connected components; the oracle's rounds suffice where no node is more than eight steps from the least one."""
    return g.components(supply_edges(spark, d))


@query(in_rounds("SELECT node, node AS community FROM nodes",
    "SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, community) AS k FROM und JOIN {r} ON {r}.node = dst GROUP BY src, community) WHERE k = 1",
    "SELECT node, community FROM {r}", 5))
def communities(spark, d):
    """Five rounds of label propagation on the supply graph."""
    return g.label_propagation(supply_edges(spark, d))


@query(in_rounds("SELECT node, 1.0::DOUBLE AS x FROM nodes",
    "SELECT node, x / max(x) OVER () AS x FROM (SELECT {r}.node AS node, any_value({r}.x) + sum(b.x) AS x FROM {r} JOIN und ON und.dst = {r}.node JOIN {r} b ON b.node = und.src GROUP BY {r}.node)",
    "SELECT node, round(x / (SELECT sqrt(sum(x * x)) FROM {r}), 5) AS centrality FROM {r}", 40, _PARTNERS))
def eigenvector(spark, d):
    """Eigenvector centrality of suppliers that offer a common part."""
    return g.partner_eigenvector(supply_numbers(spark, d), tolerance=1e-10).select(supply_name("node").alias("node"), F.round("centrality", 5).alias("centrality"))


_LEVELS = "w0 AS (SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_suppkey < 10)" + "".join(
    f", w{k} AS (SELECT * FROM w{k - 1} UNION ALL SELECT DISTINCT seed, dst AS node, {k} AS hop FROM w{k - 1} w JOIN und ON w.node = src WHERE hop = {k - 1} AND NOT EXISTS (SELECT 1 FROM w{k - 1} o WHERE o.seed = w.seed AND o.node = und.dst))"
    for k in range(1, 7)
)


@query(f"""WITH {_BOTH}, n AS (SELECT count(DISTINCT src) AS n FROM und), {_LEVELS}
SELECT seed AS node, round(CASE WHEN sum(hop) > 0 THEN (count(*) - 1) / sum(hop)::DOUBLE * (count(*) - 1) / (any_value(n) - 1) ELSE 0 END, 9) AS closeness FROM w6, n GROUP BY seed""")
def closeness(spark, d):
    """Closeness of ten suppliers in the whole supply graph."""
    return g.closeness(stored(both_ways(spark, d)), seeds(spark, d, 10)).select("node", F.round("closeness", 9).alias("closeness"))


@query()
def betweenness(spark, d):
    """Shares of the shortest ways between all nodes of the supply graph, each pair in either direction; exact."""
    return g.betweenness(g.undirected(supply_numbers(spark, d))).select(supply_name("node").alias("node"), F.round("score", 6).alias("score"))


@query(f"""WITH {_BOTH}, {_LEVELS} SELECT step, node FROM (SELECT 0 AS step, 's1' AS node UNION ALL SELECT 2, 's2' FROM w6 WHERE seed = 's1' AND node = 's2' AND hop = 2
UNION ALL SELECT 1, min(a.dst) FROM und a JOIN und b ON a.dst = b.dst WHERE a.src = 's1' AND b.src = 's2') WHERE node IS NOT NULL""")
def shortest_path(spark, d):
    """A shortest way between two suppliers (through a part that both offer)."""
    return g.shortest_path(supply_edges(spark, d), "s1", "s2")


@query(f"""WITH {_BOTH}, c AS (SELECT a.src AS node, b.dst AS other, count(*) AS common FROM und a JOIN und b ON a.dst = b.src WHERE a.src <> b.dst AND starts_with(a.src, 's') GROUP BY ALL)
SELECT node, other, common FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY common DESC, other) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM und WHERE und.src = c.node AND und.dst = c.other)) WHERE k <= 10""")
def recommend_collaborative(spark, d):
    """Each supplier's ten nodes with most common neighbours that are no neighbours."""
    every = load(spark, d, "supplier").select((F.col("s_suppkey").cast("long") * 2).alias("node"))
    return g.shared_neighbours(supply_numbers(spark, d), every, 10, supply_name)


@query(f"""WITH {_SUPPLY}, deg AS (SELECT src AS node, count(*) AS degree FROM sup GROUP BY src), k AS (SELECT s_nationkey AS community, 's' || s_suppkey AS node FROM supplier)
SELECT community, node, degree, rank FROM (SELECT community, node, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS rank FROM k JOIN deg USING (node)) WHERE rank <= 3""")
def recommend_by_community(spark, d):
    """The best connected members of each community."""
    deg = supply_edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    members = load(spark, d, "supplier").select(F.col("s_nationkey").alias("community"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    return members.join(deg, "node").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("community", "node", "degree", "rank")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def orphan_entities(spark, d):
    return load(spark, d, "part").join(load(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(f"WITH {_SUPPLY}, deg AS (SELECT dst AS node, count(*) AS degree FROM sup GROUP BY dst) SELECT node, degree FROM deg WHERE degree <= 20")
def knowledge_gaps(spark, d):
    """Sparsely connected entities."""
    return supply_edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree")).filter("degree <= 20")


_COMMUNITY = "c AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS community FROM supplier UNION ALL SELECT 'p' || p_partkey, p_brand FROM part)"


def membership(spark, d):
    """Communities: a supplier's nation, a part's brand."""
    sup = load(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("community"))
    return sup.unionByName(load(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"), F.col("p_brand").alias("community")))


@query(f"""WITH {_SUPPLY}, {_COMMUNITY} SELECT a.community AS community, b.community AS other, count(*) AS n_edges, round(sum(weight), 2) AS weight FROM sup JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.community <> b.community GROUP BY ALL""")
def related_communities(spark, d):
    """Edges that cross communities."""
    m = membership(spark, d)
    rows = supply_edges(spark, d).join(m.withColumnsRenamed({"node": "src"}), "src").join(m.withColumnsRenamed({"node": "dst", "community": "other"}), "dst")
    return rows.filter("community <> other").groupBy("community", "other").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 2).alias("weight"))


@query(f"""WITH {_BOTH}, c AS (SELECT src AS node, min(dst) AS community FROM und GROUP BY src), i AS (SELECT a.community, count(*) AS inner_edges FROM sup JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.community = b.community GROUP BY 1)
SELECT community, count(*) AS size, coalesce(any_value(inner_edges), 0) AS inner_edges, round(CASE WHEN count(*) > 1 THEN coalesce(any_value(inner_edges), 0) / (count(*) * (count(*) - 1) / 2.0::DOUBLE) ELSE 0 END, 6) AS density FROM c LEFT JOIN i USING (community) GROUP BY community""")
def community_statistics(spark, d):
    """Size, inner edges (each once) and density of communities (here: nodes with the same least neighbour)."""
    edges = supply_edges(spark, d)
    m = g.undirected(edges).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("community"))
    return g.community_density(edges, m).withColumn("density", F.round("density", 6))


@query(f"""WITH {_SUPPLY}, ch AS (SELECT src, dst FROM sup WHERE weight > 50) SELECT a.s_name AS source, p_name AS target, b.s_name AS other, count(*) AS n FROM ch x JOIN ch y ON x.dst = y.dst AND x.src < y.src
JOIN supplier a ON 's' || a.s_suppkey = x.src JOIN supplier b ON 's' || b.s_suppkey = y.src JOIN part ON 'p' || p_partkey = x.dst GROUP BY ALL""")
def pattern_match(spark, d):
    """(a)-[supplies]->(part)<-[supplies]-(b) of strong edges, with names."""
    strong = supply_edges(spark, d).filter("weight > 50")
    sup = load(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.col("s_name").alias("name"))
    part = load(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("dst"), F.col("p_name").alias("target"))
    x, y = strong.select(F.col("src").alias("a"), "dst"), strong.select(F.col("src").alias("b"), "dst")
    rows = x.join(y, "dst").filter("a < b").join(part, "dst")
    rows = rows.join(sup.withColumnsRenamed({"node": "a", "name": "source"}), "a").join(sup.withColumnsRenamed({"node": "b", "name": "other"}), "b")
    return rows.groupBy("source", "target", "other").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderpriority AS community, list_sort(list(DISTINCT o_custkey)) AS m FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN '0-NEW' ELSE o_orderpriority END AS community, list_sort(list(DISTINCT o_custkey)) AS m FROM orders WHERE o_orderstatus <> CASE WHEN o_orderpriority = '2-HIGH' THEN 'O' ELSE 'P' END GROUP BY 1),
j AS (SELECT coalesce(a.community, b.community) AS community, CASE WHEN b.community IS NULL THEN 'new' WHEN a.community IS NULL THEN 'removed' WHEN a.m <> b.m THEN 'updated' ELSE 'same' END AS delta FROM a FULL JOIN b ON a.community = b.community) SELECT * FROM j""")
def community_delta(spark, d):
    """New, removed and updated communities between two snapshots, by digests of their members."""
    rows, kind = load(spark, d, "orders"), F.col("o_orderpriority")
    before = rows.filter("o_orderstatus <> 'P'").select(kind.alias("community"), F.col("o_custkey").alias("node"))
    after = rows.filter(F.col("o_orderstatus") != F.when(kind == "2-HIGH", "O").otherwise("P"))
    after = after.select(F.when(kind == "1-URGENT", "0-NEW").otherwise(kind).alias("community"), F.col("o_custkey").alias("node"))
    return g.community_delta(before, after)
