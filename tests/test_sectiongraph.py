"""The section graph against plain loops."""

import random

from tessera.operators import sectiongraph as s


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, doc string, seq int, level int, heading string, text string")


def kinds(frame_):
    return {(r.src, r.dst) for r in frame_.collect()}


def test_order_and_hierarchy(spark):
    r, rows = random.Random(2), []
    for doc in "abcd":
        rows += [(ord(doc) * 100 + k, doc, k, r.randint(1, 6), f"heading {k}", "") for k in range(25)]
    want = set()
    for i, doc, k, level, *_ in rows:
        above = [x for x in rows if x[1] == doc and x[2] < k and x[3] < level]
        if above:
            want.add((max(above, key=lambda x: x[2])[0], i))
    assert kinds(s.parents(frame(spark, rows))) == want
    assert kinds(s.follows(frame(spark, rows))) == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and b[2] == a[2] + 1}


def test_references(spark):
    rows = [
        (1, "x", 0, 1, "Introduction to graphs", "See the Data model, then go on."),
        (2, "x", 1, 2, "Data model", "As the introduction to it says: DATA MODEL!"),
        (3, "x", 2, 2, "An end", "an end; data  model"),
        (4, "y", 0, 1, "Other", "Data model"),
        (5, "x", 3, 1, None, None),
        (6, "x", 4, 1, "", ""),
    ]
    assert kinds(s.references(frame(spark, rows))) == {(1, 2), (3, 2), (2, 1)}


def test_similar_sections_and_communities(spark):
    rows = [(k, "x" if k < 4 else "y", k % 4, 1 if k % 4 == 0 else 2, f"h{k}", "") for k in range(8)]
    points = spark.createDataFrame([(0, [1.0, 0.1]), (1, [1.0, 0.2]), (4, [0.0, 1.0]), (7, [0.1, 1.0])], "id long, embedding array<double>")
    edges = s.section_graph(frame(spark, rows), points, 0.8)
    assert kinds(edges.filter("kind = 'SIMILAR_TO'")) == {(0, 1), (4, 7)}
    got = {r.node: r.community for r in s.section_communities(edges).collect()}
    assert got == {k: 0 if k < 4 else 4 for k in range(8)}
    empty = frame(spark, [])
    assert s.section_graph(empty).count() == 0
