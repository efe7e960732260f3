"""Patterns against plain walks over small graphs."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessera.operators import patterns
from tessera.operators.patterns import pattern
from tessera.operators.templates import Templates


def graph(spark, edges, labels=None):
    names = sorted({n for _, a, b, _ in edges for n in (a, b)})
    nodes = spark.createDataFrame([(n, (labels or {}).get(n, "x"), n.upper()) for n in names], "id string, label string, name string")
    return pattern(nodes, spark.createDataFrame(edges, "id long, src string, dst string, type string"))


def plain_walks(edges, start, least, most, kind, direction):
    ways = [(i, a, b) for i, a, b, t in edges if kind in (None, t) and direction in ("->", "-")]
    ways += [(i, b, a) for i, a, b, t in edges if kind in (None, t) and (direction == "<-" or direction == "-" and a != b)]
    out, front = [], [(s, s, ()) for s in start]
    for hop in range(most + 1):
        if hop >= least:
            out += front
        front = [(s, y, (*used, i)) for s, x, used in front for i, a, y in ways if a == x and i not in used]
    return Counter((s, x, used) for s, x, used in out)


@pytest.fixture(scope="module")
def edges():
    r = random.Random(3)
    return [(k, r.choice("abcde"), r.choice("abcdef"), r.choice(["R", "S"])) for k in range(11)] + [(20, "a", "a", "R"), (21, "a", "b", "R"), (22, "b", "a", "R")]


@pytest.mark.parametrize("least, most, kind, direction", [(0, 2, None, "-"), (1, 1, "R", "->"), (1, 3, None, "<-"), (2, 3, "R", "-"), (0, 0, None, "->"), (3, 3, "S", "-")])
def test_walks(spark, edges, least, most, kind, direction):
    p = graph(spark, edges).node("x").relationship("x", kind, "y", direction, least, most, name="r")
    got = Counter((r.x, r.y, tuple(r.r)) for r in p.matches("x", "y", "r").collect())
    assert got == plain_walks(edges, {n for _, a, b, _ in edges for n in (a, b)}, least, most, kind, direction)


def test_no_edge_is_used_twice_in_a_match(spark):
    p = graph(spark, [(1, "a", "b", "R"), (2, "c", "b", "R")]).node("x").relationship("x", "R", "y").relationship("y", "R", "z", "<-")
    assert {(r.x, r.y, r.z) for r in p.matches().collect()} == {("a", "b", "c"), ("c", "b", "a")}


def test_bound_targets_make_cycles(spark):
    edges = [(1, "a", "b", "R"), (2, "b", "c", "R"), (3, "c", "a", "R"), (4, "c", "d", "R")]
    p = graph(spark, edges).node("x", "id = 'a'").relationship("x", "R", "y", "->", 1, 2).relationship("y", "R", "x", "->", 1, 3)
    assert sorted((r.x, r.y) for r in p.matches().collect()) == [("a", "b"), ("a", "c")]


def test_narrowing_properties_and_shortest(spark):
    edges = [(1, "a", "b", "R"), (2, "b", "c", "R"), (3, "a", "c", "S"), (4, "c", "e", "R")]
    p = graph(spark, edges, {"c": "end", "e": "end"}).node("x", "id = 'a'").relationship("x", None, "y", "->", 1, 3, name="r").node("y", "label = 'end'")
    assert {tuple(r) for r in p.shortest("x", "y", "r").collect()} == {("a", "c", 1), ("a", "e", 2)}
    assert {r.y_name for r in p.properties("y", "name").where("r_hops = 2").matches(distinct=True).collect()} == {"C", "E"}


def test_misuse_is_told(spark, edges):
    g = graph(spark, edges)
    with pytest.raises(ValueError):
        g.relationship("x", "R", "y")
    with pytest.raises(ValueError):
        g.node("x").relationship("x", "R", "y", "=>")
    with pytest.raises(ValueError):
        g.node("x").relationship("x", "R", "y", "->", 3, 2)
    with pytest.raises(ValueError):
        g.node("x").node("y")


def test_templates(spark):
    edges = spark.createDataFrame([(1, "a", "b", "R"), (2, "b", "c", "R"), (3, "c", "d", "S"), (4, "b", "b", "S"), (5, "a", "d", "S")], "id long, src string, dst string, type string")
    nodes = spark.createDataFrame([(x, "even" if x in "bd" else "odd", x.upper() + "x", f"2024-01-0{k + 1} 00:00:00") for k, x in enumerate("abcdef")], "id string, label string, name string, at string")
    t = Templates(nodes.withColumn("created_at", nodes["at"].cast("timestamp")), edges)
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(t.neighbours("a", 2)) == [("b", 1), ("c", 2), ("d", 1)] and rows(t.neighbours("a", 3, "R")) == [("b", 1), ("c", 2)]
    assert rows(t.relationships("b")) == [("a", 1), ("b", 4), ("c", 2)] and rows(t.relationships("b", "<-", "R")) == [("a", 1)]
    assert rows(t.path("a", "c")) == [(2,)] and rows(t.path("a", "a")) == [(0,)] and rows(t.path("a", "e")) == []
    assert rows(t.subgraph(["Ax"], 1).select("id")) == [(1,), (4,), (5,)]
    assert rows(t.degrees()) == [("a", 2), ("b", 3), ("c", 2), ("d", 2)] and [r.id for r in t.orphans().orderBy("id").collect()] == ["e", "f"]
    assert rows(t.highly_connected(3)) == [("b", 3)] and rows(t.degree_distribution()) == [(2, 3), (3, 1)]
    assert [r.id for r in t.by_type("odd", 2).collect()] == ["a", "c"] and [r.id for r in t.search("X", 3).collect()] == ["a", "b", "c"]
    assert [r.id for r in t.recent("2024-01-05").orderBy("id").collect()] == ["e", "f"] and rows(t.similar("b")) == [("d", 2)]
    assert [r.id for r in t.relationships_by_type("S", 2).collect()] == [5, 4] and t.lookup("Cx").first().id == "c"


@pytest.mark.parametrize("least, most, kind, direction", [(0, 2, None, "-"), (1, 1, "R", "->"), (1, 3, None, "<-"), (2, 3, "R", "-"), (0, 0, None, "->")])
@pytest.mark.parametrize("most_walks", [5, 1000])
def test_walk_counts(spark, edges, least, most, kind, direction, most_walks, monkeypatch):
    monkeypatch.setattr(patterns, "WALKS", most_walks)
    monkeypatch.setattr(patterns, "LISTED", 3)
    got = {(r.x, r.end, r.hops): r.n for r in graph(spark, edges).node("x").walk_counts("x", kind, direction, least, most).collect()}
    want = Counter((s, x, len(used)) for (s, x, used), n in plain_walks(edges, {n for _, a, b, _ in edges for n in (a, b)}, least, most, kind, direction).items() for _ in range(n))
    assert got == want


def test_walks_through_one_node_are_counted_in_many_tasks(spark, monkeypatch):
    """a node's walks are the square of its edges; no task counts them all, and they are not shuffled."""
    monkeypatch.setattr(patterns, "WALKS", 500)
    df = graph(spark, [(k, f"s{k:03}", "hub", "R") for k in range(100)]).node("x", "id <> 'hub'").walk_counts("x", None, "-", 2)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100 * 99 and max(sizes) < 1500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
