"""Graph steps whose plans must not shuffle what grows with the square of a node's degree."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph as g


def plain_partners(rows):
    by = {}
    for a, b in rows:
        by.setdefault(b, set()).add(a)
    return {(x, y) for own in by.values() for x in own for y in own if x != y}


def plain_centrality(pairs, rounds=300):
    nodes = sorted({x for p in pairs for x in p})
    x = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        new = dict(x)
        for a, b in pairs:
            new[b] += x[a]
        length = sum(v * v for v in new.values()) ** 0.5
        x = {n: v / length for n, v in new.items()}
    return x


def supply(seed=3):
    r = random.Random(seed)
    return {(f"s{r.randint(0, 30)}", f"p{r.randint(0, 25)}") for _ in range(80)} | {("s99", "p99")}


def test_partner_centrality_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(g, "PIECE", 4)  # lists of a node come in pieces
    rows = supply()
    edges = spark.createDataFrame(sorted(rows) * 2, "src string, dst string")
    got = {x.node: x.centrality for x in g.partner_eigenvector(edges, tolerance=1e-7).collect()}
    want = plain_centrality(plain_partners(rows))
    assert set(got) == set(want) and "s99" not in got
    assert all(abs(got[n] - v) < 1e-4 for n, v in want.items())
    pairs = spark.createDataFrame(sorted(plain_partners(rows)), "src string, dst string")
    other = {x.node: x.centrality for x in g.eigenvector(pairs, tolerance=1e-7).collect()}
    assert all(abs(other[n] - v) < 1e-4 for n, v in want.items())


def test_pairs_are_made_behind_the_last_shuffle(spark):
    """Rows written to shuffles are lists by edge: four exchanges, and none behind the pairs."""
    own = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "node long, via string")
    ends = own.select("via", F.col("node").alias("num"))
    pairs = g.beside(own, ends)
    plan = pairs.distinct()._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2)]


def test_shared_neighbours_equal_a_loop(spark):
    r = random.Random(5)
    rows = {(f"n{r.randint(0, 14)}", f"n{r.randint(0, 14)}") for _ in range(40)}
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seeds = ["n1", "n2", "n3", "n77"]
    want = {}
    for s in seeds:
        for via in near.get(s, ()):
            for o in near[via] - {s} - near[s]:
                want[s, o] = want.get((s, o), 0) + 1
    edges = spark.createDataFrame(sorted(rows), "src string, dst string")
    asked = spark.createDataFrame([(s,) for s in seeds], "node string")
    got = {(x.node, x.other): x.common for x in g.shared_neighbours(edges, asked).collect()}
    assert got == want and len(got) > 10
    best = {(x.node, x.other) for x in g.shared_neighbours(edges, asked, most=2).collect()}
    assert best == {(s, o) for s in seeds for _, o in sorted((-n, o) for (k, o), n in want.items() if k == s)[:2]}


def test_closeness_keeps_a_row_for_each_node(spark, monkeypatch):
    """seeds are bits of a node's row, searched from in blocks."""
    monkeypatch.setattr(g, "SEEDS", 3)
    r = random.Random(8)
    rows = sorted({(r.randint(0, 11), r.randint(0, 11)) for _ in range(25)} | {(20, 21)})
    nodes = sorted({x for e in rows for x in e})
    got = {x.node: x.closeness for x in g.closeness(spark.createDataFrame(rows, "src int, dst int"), spark.createDataFrame([(x,) for x in [*nodes, 99]], "node int")).collect()}
    want = {99: 0.0}
    for seed in nodes:
        hops, front = {seed: 0}, {seed}
        while front:
            front = {a for a, b in rows if b in front} - hops.keys()
            hops |= dict.fromkeys(front, max(hops.values()) + 1)
        n, steps = len(hops) - 1, sum(hops.values())
        want[seed] = n / steps * n / (len(nodes) - 1) if steps else 0.0
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_labels_are_numbers_in_the_rounds(spark, monkeypatch):
    """names are shuffled before and after the rounds only, and ties go by their order."""
    kinds = []
    dealt = g.by_node
    monkeypatch.setattr(g, "by_node", lambda df, key: (kinds.append(df.schema[key].dataType.simpleString()), dealt(df, key))[1])
    edges = sorted(supply(4) | {("x", "x")})
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    labels = {n: n for n in near}
    for _ in range(3):
        votes = {n: [labels[o] for o in own] for n, own in near.items()}
        labels = {n: min(set(v), key=lambda x: (-v.count(x), x)) for n, v in votes.items()}
    got = {x.node: x.community for x in g.label_propagation(spark.createDataFrame(edges, "src string, dst string"), 3).collect()}
    assert got == labels and kinds == ["bigint"]


def shares_of_ways(rows):
    """Brandes' sums from every node of directed edges, one after another."""
    near, nodes = {}, sorted({x for e in rows for x in e})
    for a, b in sorted(set(rows)):
        if a != b:
            near.setdefault(a, []).append(b)
    score = dict.fromkeys(nodes, 0.0)
    for seed in nodes:
        hop, ways, order = {seed: 0}, {seed: 1}, [seed]
        for x in order:
            for y in near.get(x, ()):
                if y not in hop:
                    hop[y], ways[y] = hop[x] + 1, 0
                    order.append(y)
                if hop[y] == hop[x] + 1:
                    ways[y] += ways[x]
        part = dict.fromkeys(order, 0.0)
        for x in order[::-1]:
            part[x] = sum(ways[x] / ways[y] * (1 + part[y]) for y in near.get(x, ()) if hop[y] == hop[x] + 1)
            score[x] += part[x] * (x != seed)
    return score


def test_betweenness_from_all_nodes(spark, monkeypatch):
    """all nodes are seeds, in tasks of few steps, together with other components, and by joins for large ones."""
    r = random.Random(12)
    rows = sorted({(r.randint(0, 13), r.randint(0, 13)) for _ in range(34)} | {(20 + k, 21 + k) for k in range(4)} | {(40, 41), (41, 40), (50, 50)})
    edges = spark.createDataFrame(rows, "src int, dst int")
    want = shares_of_ways([e for e in rows if e[0] != e[1]])
    for limits in ({}, {"STEPS": 60, "FEW_WAYS": 10}, {"WAYS": 15, "FEW_WAYS": 5, "SEARCHED": 120}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(g, name, value)
            got = {x.node: x.score for x in g.betweenness(edges).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_betweenness_query_counts_every_pair(spark, sf):
    """the query's scores are of all nodes as seeds, not scaled from five of them."""
    from tessera.plans.graph import betweenness
    from tessera.sources.tables import supply_edges

    pairs = [(x.src, x.dst) for x in supply_edges(spark, sf).collect()]
    want = shares_of_ways(pairs + [(b, a) for a, b in pairs])
    got = {x.node: x.score for x in betweenness(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)


def lists_sent(rows):
    """Numbers that ``beside`` shuffles: each node gets the whole list of each of its ways."""
    degree = {}
    for _, b in rows:
        degree[b] = degree.get(b, 0) + 1
    return sum(n * n for n in degree.values())


def test_two_steps_send_a_list_to_a_block_once(spark, monkeypatch):
    """a list went to each node of a via; now to each block, in passes where that is much."""
    rows = [(a, b) for a in range(40) for b in range(100, 130)]
    sent = []

    def spy(df, keep=g.stored):
        table = keep(df)
        sent.append((table.columns, table.count()))
        return table

    monkeypatch.setattr(g, "stored", spy)
    one = spark.createDataFrame(rows, "node long, via long")
    out = g.two_steps(one, one.select("via", "node"), g._best_shared(None), "node long, other long, common long")
    assert sorted(map(tuple, out.collect())) == [(a, b, 30) for a in range(40) for b in range(40) if a != b]
    assert next(n for names, n in sent if names == ["via", "block", "own"]) * 40 <= lists_sent(rows) / 10
    monkeypatch.setattr(g, "SENT", 500)  # three passes of small blocks, small slices and steps
    monkeypatch.setattr(g, "STEPPED", 3000)
    monkeypatch.setattr(g, "SLICE", 7)
    out = g.two_steps(one, one.select("via", "node"), g._best_shared(3), "node long, other long, common long")
    assert sorted(map(tuple, out.collect())) == [(a, b, 30) for a in range(40) for b in range(40) if a != b]


def test_best_neighbours_of_numbers_go_by_name(spark):
    """Ties of numbered nodes are broken by their names, as SQL breaks them."""
    rows = [(2 * a, 2 * b + 1) for a in range(15) for b in range(4)]
    from tessera.sources.tables import supply_name

    edges, asked = spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame([(2,)], "node long")
    got = [tuple(x) for x in g.shared_neighbours(edges, asked, 3, supply_name).collect()]
    assert sorted(got) == [("s1", "s0", 4), ("s1", "s10", 4), ("s1", "s11", 4)]


def test_ranks_free_their_rounds(spark, monkeypatch):
    """ten rounds were one job, whose shuffles were all kept; each is a table now, and sums of blocks are shuffled."""
    r = random.Random(6)
    rows = sorted({(r.randint(0, 30), r.randint(0, 40)) for _ in range(150)} | {(1 << 60, 5), (3, 1 << 60)})
    nodes, near = sorted({x for e in rows for x in e}), {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        lost = sum(want[x] for x in nodes if x not in near)
        got = dict.fromkeys(nodes, lost / len(nodes))
        for a, own in near.items():
            for b in own:
                got[b] += want[a] / len(own)
        want = {x: 0.15 / len(nodes) + 0.85 * got[x] for x in nodes}
    tables = []
    monkeypatch.setattr(g, "RANKED", 20)
    monkeypatch.setattr(g, "stored", lambda df, keep=g.stored: tables.append(df.columns) or keep(df))
    found = {x.node: x.rank for x in g.pagerank(spark.createDataFrame(rows, "src long, dst long"), 4).collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-12 for x in want)
    assert tables.count(["node", "block", "rank"]) == 5
