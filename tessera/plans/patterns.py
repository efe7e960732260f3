"""Pattern queries on the graph of suppliers, parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.patterns import pattern
from tessera.operators.templates import Templates
from tessera.plans.registry import query
from tessera.sources.tables import load

#: An edge is a supplier's part of which it delivered enough, or a supplier's nation.
_GRAPH = """e AS (SELECT 's' || l_suppkey || '>p' || l_partkey AS id, 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'SUPPLIES' AS type FROM lineitem GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) >= {least}
UNION ALL SELECT 's' || s_suppkey || '>n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'IN' FROM supplier),
u AS (SELECT id, src AS a, dst AS b, type FROM e UNION ALL SELECT id, dst, src, type FROM e WHERE src <> dst)"""


def graph(spark, d, least=90):
    s = lambda c, x: F.concat(F.lit(x), F.col(c))
    line = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).filter(F.col("q") >= least)
    line = line.select(F.concat(s("l_suppkey", "s"), F.lit(">"), s("l_partkey", "p")).alias("id"), s("l_suppkey", "s").alias("src"), s("l_partkey", "p").alias("dst"), F.lit("SUPPLIES").alias("type"))
    supplier = load(spark, d, "supplier")
    home = supplier.select(F.concat(s("s_suppkey", "s"), F.lit(">"), s("s_nationkey", "n")).alias("id"), s("s_suppkey", "s").alias("src"), s("s_nationkey", "n").alias("dst"), F.lit("IN").alias("type"))
    nodes = supplier.select(s("s_suppkey", "s").alias("id"), F.lit("Supplier").alias("label"), F.col("s_name").alias("name"))
    nodes = nodes.unionByName(load(spark, d, "part").select(s("p_partkey", "p").alias("id"), F.lit("Part").alias("label"), F.col("p_name").alias("name")))
    nodes = nodes.unionByName(load(spark, d, "nation").select(s("n_nationkey", "n").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name")))
    return pattern(nodes, line.unionByName(home))


def _walks(least, most, kind, start):
    """SQL: walks without a repeated edge from the starts, in either direction, by recursion."""
    return f"""WITH RECURSIVE {_GRAPH.format(least=90)}, w AS (SELECT id AS a, id AS b, []::VARCHAR[] AS used, 0 AS hops FROM (SELECT 's' || s_suppkey AS id FROM supplier WHERE {start})
UNION ALL SELECT w.a, u.b, list_append(used, u.id), hops + 1 FROM w JOIN u ON u.a = w.b WHERE hops < {most} AND NOT list_contains(used, u.id) {kind})
SELECT a, b, hops, count(*) AS n FROM w WHERE hops >= {least} GROUP BY ALL"""


def walks(spark, d, least, most, kind, start):
    return graph(spark, d).node("a", start).walk_counts("a", kind, "-", least, most).withColumnRenamed("end", "b")


@query(_walks(0, 2, "", "true"))
def walks_from_zero(spark, d):
    """Walks of none to two edges in any direction from every supplier."""
    return walks(spark, d, 0, 2, None, "label = 'Supplier'")


@query(_walks(1, 4, "AND type = 'SUPPLIES'", "true"))
def walks_of_supply(spark, d):
    """Walks of one to four supplies, so that those of four may come back to their beginning."""
    return walks(spark, d, 1, 4, "SUPPLIES", "label = 'Supplier'")


@query(_walks(2, 3, "AND type = 'SUPPLIES'", "s_suppkey % 2 = 0"))
def walks_from_two(spark, d):
    """Walks of two or three supplies from suppliers of an even key."""
    return walks(spark, d, 2, 3, "SUPPLIES", F.col("id").rlike("^s[0-9]*[02468]$"))


@query(f"""WITH {_GRAPH.format(least=45)} SELECT x.src AS a, y.src AS b, count(*) AS n FROM e x JOIN e p ON p.dst = x.dst AND p.id <> x.id JOIN e y ON y.src = p.src AND y.type = 'IN' JOIN e z ON z.src = x.src AND z.type = 'IN' AND z.dst = y.dst
WHERE x.type = 'SUPPLIES' AND p.type = 'SUPPLIES' GROUP BY ALL""")
def pattern_cycles(spark, d):
    """(a)-[:SUPPLIES]->(p)<-[:SUPPLIES]-(b)-[:IN]->(n)<-[:IN]-(a): suppliers of one part and one nation."""
    rows = graph(spark, d, 45).node("a", "label = 'Supplier'").relationship("a", "SUPPLIES", "p").relationship("p", "SUPPLIES", "b", "<-")
    rows = rows.relationship("b", "IN", "n").relationship("n", "IN", "a", "<-").matches("a", "b")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_GRAPH.format(least=90)}, w AS (SELECT 's' || s_suppkey AS a, 's' || s_suppkey AS b, 0 AS hops FROM supplier UNION SELECT w.a, u.b, hops + 1 FROM w JOIN u ON u.a = w.b WHERE hops < 3 AND u.type = 'SUPPLIES'),
s AS (SELECT a, b, min(hops) AS hops FROM w GROUP BY a, b) SELECT a, s_name AS a_name, b, p_name AS b_name, hops FROM s JOIN supplier ON 's' || s_suppkey = a JOIN part ON 'p' || p_partkey = b WHERE hops > 0""")
def template_nearest_parts(spark, d):
    """The path template: every part within three supplies of a supplier, with names and the least distance."""
    p = graph(spark, d).node("a", "label = 'Supplier'").relationship("a", "SUPPLIES", "b", "-", 1, 3, name="r").node("b", "label = 'Part'")
    near = p.shortest("a", "b", "r")
    return p._with(near).properties("a", "name").properties("b", "name").matches("a", "a_name", "b", "b_name", "hops")


@query(f"""WITH {_GRAPH.format(least=45)}, nd AS (SELECT 's' || s_suppkey AS id, 'Supplier' AS label, s_name AS name FROM supplier UNION ALL SELECT 'p' || p_partkey, 'Part', p_name FROM part UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation),
one AS (SELECT DISTINCT b FROM u WHERE a = 's1'), two AS (SELECT DISTINCT y.b FROM u x JOIN u y ON y.a = x.b AND y.id <> x.id WHERE x.a = 's1'),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), ins AS (SELECT 's1' AS b UNION SELECT b FROM one)
SELECT 'neighbours' AS template, b AS a, '' AS b, min(h)::BIGINT AS n FROM (SELECT b, 1 AS h FROM one UNION ALL SELECT b, 2 FROM two) WHERE b <> 's1' GROUP BY b
UNION ALL SELECT 'outgoing', b, id, 1 FROM (SELECT dst AS b, id FROM e WHERE src = 's1') UNION ALL SELECT 'incoming', src, id, 1 FROM e WHERE dst = 'n3'
UNION ALL SELECT 'statistics', label, '', count(*) FROM nd GROUP BY label UNION ALL SELECT 'relationship_statistics', type, '', count(*) FROM e GROUP BY type
UNION ALL SELECT 'orphans', id, name, 1 FROM nd WHERE id NOT IN (SELECT id FROM deg) UNION ALL SELECT 'highly_connected', id, '', degree FROM deg WHERE degree >= 5
UNION ALL SELECT 'degree_distribution', degree::VARCHAR, '', count(*) FROM deg GROUP BY degree UNION ALL SELECT 'subgraph', src, dst, 1 FROM e WHERE src IN (SELECT b FROM ins) AND dst IN (SELECT b FROM ins)
UNION ALL (SELECT 'search', id, name, 1 FROM nd WHERE contains(lower(name), 'an') ORDER BY name, id LIMIT 20) UNION ALL (SELECT 'by_type', id, name, 1 FROM nd WHERE label = 'Part' ORDER BY name, id LIMIT 50)
UNION ALL (SELECT 'by_relationship', src, dst, 1 FROM e WHERE type = 'SUPPLIES' ORDER BY src, dst LIMIT 100) UNION ALL SELECT 'lookup', id, name, 1 FROM nd WHERE name = (SELECT min(s_name) FROM supplier)
UNION ALL (SELECT 'similar', b, '', common FROM (SELECT y.b, count(DISTINCT x.b) AS common FROM u x JOIN u y ON y.a = x.b AND y.id <> x.id JOIN nd ON nd.id = y.b AND label = 'Supplier' WHERE x.a = 's1' AND y.b <> 's1' GROUP BY y.b) ORDER BY common DESC, b LIMIT 10)""")
def template_answers(spark, d):
    """Fourteen stock questions on the graph of suppliers, parts and nations, answered as rows."""
    p = graph(spark, d, 45)
    t, name = Templates(p.nodes, p.edges), load(spark, d, "supplier").agg(F.min("s_name")).first()[0]
    none, one = F.lit(""), F.lit(1)
    answers = {
        "neighbours": (t.neighbours("s1", 2), "b", none, "hops"),
        "outgoing": (t.relationships("s1", "->"), "b", "edge", one),
        "incoming": (t.relationships("n3", "<-"), "b", "edge", one),
        "statistics": (t.statistics(), "label", none, "n"),
        "relationship_statistics": (t.relationship_statistics(), "type", none, "n"),
        "orphans": (t.orphans(), "id", "name", one),
        "highly_connected": (t.highly_connected(5), "id", none, "degree"),
        "degree_distribution": (t.degree_distribution(), "degree", none, "n"),
        "subgraph": (t.subgraph(["s1"], 1), "src", "dst", one),
        "search": (t.search("an", 20), "id", "name", one),
        "by_type": (t.by_type("Part"), "id", "name", one),
        "by_relationship": (t.relationships_by_type("SUPPLIES"), "src", "dst", one),
        "lookup": (t.lookup(name), "id", "name", one),
        "similar": (t.similar("s1"), "b", none, "common"),
    }
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    out = None
    for template, (rows, a, b, n) in answers.items():
        part = rows.select(F.lit(template).alias("template"), as_column(a).cast("string").alias("a"), as_column(b).cast("string").alias("b"), as_column(n).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
