"""The similarity join and what rests on it, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import entities, memory
from tessera.operators import similarity as s


def clustered(seed=1, groups=40, size=12, d=24, noise=0.08):
    r = np.random.default_rng(seed)
    x = np.repeat(r.normal(size=(groups, d)), size, axis=0) + r.normal(scale=noise, size=(groups * size, d)) * r.uniform(0.2, 3, (groups * size, 1))
    return x


def frame(spark, x, scope=None):
    rows = [(k, v.tolist(), None if scope is None else str(scope[k])) for k, v in enumerate(x)]
    out = spark.createDataFrame(rows, "id long, embedding array<double>, scope string")
    return out if scope is not None else out.drop("scope")


def plain_pairs(x, least, scope=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if score[i, j] >= least and (scope is None or scope[i] == scope[j])}


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(s, "CELL", 40)
    monkeypatch.setattr(s, "BLOCK", 64)


@pytest.mark.parametrize("least", [0.97, 0.9, 0.5])
def test_exact_join_loses_nothing(spark, small_cells, least):
    x, scope = clustered(), np.arange(480) % 3
    got = [(r.a, r.b) for r in s.near_pairs(frame(spark, x, scope), least).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(x, least, scope)


def test_recall_with_fewer_guests(spark, small_cells):
    x = clustered(seed=2, groups=120, size=10, d=48)
    want = plain_pairs(x, 0.93)
    got = {(r.a, r.b) for r in s.near_pairs(frame(spark, x), 0.93, slack=0.5).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 1000


def test_odd_vectors_have_no_partner(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1e300, 0.0]), (3, [1e-300, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, None]), (None, [1.0, 0.0])]
    got = s.near_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.9).collect()
    assert {(r.a, r.b, r.score) for r in got} == {(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)}
    assert s.near_pairs(spark.createDataFrame([], "id long, embedding array<double>"), 0.9).count() == 0


def test_equal_vectors_are_one(spark):
    rows = [(k, [1.0, 2.0] if k % 2 else [2.0, 1.0], "ab"[k % 3 == 0]) for k in range(30)]
    members, reps = s.distinct_vectors(spark.createDataFrame(rows, "id long, embedding array<double>, scope string"))
    assert members.count() == 30 and sorted((r.id, r.n) for r in reps.collect()) == [(0, 5), (1, 10), (2, 10), (3, 5)]


def plain_first(n, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    keeper, kept = {}, []
    for k in range(n):
        mine = [x for x in kept if x in near.get(k, ())]
        keeper[k] = mine[0] if mine else k
        if not mine:
            kept.append(k)
    return keeper


def test_first_come_pass_equals_a_loop(spark):
    r = np.random.default_rng(5)
    for n, m in ((60, 40), (60, 200), (40, 39), (10, 0)):
        pairs = {tuple(sorted(map(int, r.choice(n, 2, replace=False)))) for _ in range(m)} if m != 39 else {(k, k + 1) for k in range(39)}
        got = s.first_kept(spark.createDataFrame(list(pairs), "a long, b long"), spark.createDataFrame([(k, k) for k in range(n)], "id long, place long"))
        assert {x.id: x.keeper for x in got.collect()} == plain_first(n, pairs)


def test_consolidation_equals_a_loop(spark):
    x = clustered(seed=3, groups=15, size=6, d=8, noise=0.1)
    x[7] = x[3]
    x[20] = 0
    rows = [(k, v.tolist(), float(k * 37 % 11) if k != 4 else None) for k, v in enumerate(x)]
    fine = [k for k in range(len(x)) if k != 20]
    index = {k: i for i, k in enumerate(fine)}
    keeper = plain_first(len(fine), plain_pairs(x[fine], 0.95))
    kept = [k for k in range(len(x)) if k == 20 or keeper[index[k]] == index[k]]
    got = memory.consolidated(spark.createDataFrame(rows, "id long, embedding array<double>, relevance double"), 0.95, 0.4)
    order = sorted(kept, key=lambda k: (-(rows[k][2] or 0.0), k))[: max(1, int(len(kept) * 0.4))]
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(k, i + 1) for i, k in enumerate(order)]


def plain_linkage(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u.T
    parts = [[k] for k in range(len(x))]
    while len(parts) > 1:
        best, a, b = max((round(score[np.ix_(p, q)].mean(), 9), -i, -j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
        if best <= least:
            break
        a, b = -a, -b
        parts[a] += parts.pop(b)
    return {k: min(p) for p in parts for k in p}


@pytest.mark.parametrize("least", [0.88, 0.6])
def test_average_linkage_equals_a_plain_dendrogram(spark, least):
    x = clustered(seed=4, groups=7, size=6, d=6, noise=0.35)
    got = {r.id: r.cluster for r in s.average_linkage(frame(spark, x), least).collect()}
    assert got == plain_linkage(x, least) and 3 < len(set(got.values())) < 40


def test_average_linkage_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 0.0])]
    got = {r.id: r.cluster for r in s.average_linkage(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.88).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_names_by_embedding(spark):
    x = clustered(seed=6, groups=10, size=5, d=16, noise=0.05)
    names = frame(spark, x).select((F.col("id") + 100).alias("id"), F.lit("k").alias("kind"), F.md5(F.col("id").cast("string").cast("binary")).alias("name"), "embedding")
    got = {r.id - 100: r.canonical - 100 for r in entities.same_entities(names, cosine=0.9).collect()}
    assert got == {k: k // 5 * 5 for k in range(50)}


def test_spherical_clusters(spark):
    from tessera.operators import knowledge

    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(c, 0.2, (20, 3)) for c in ([3, 0, 0], [0, 3, 0], [0, 0, 3])])[r.permutation(60)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0]), (None, [1.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    centres = x[:6].copy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = lambda: np.round(u @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T, 6)
    for _ in range(4):
        at = near().argmax(axis=1)
        for j in np.unique(at):
            centres[j] = x[at == j].mean(axis=0)
    got = {q.id: (q.cluster, q.score) for q in knowledge.spherical(points, 6, rounds=4).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(near().argmax(axis=1).tolist()))
    assert all(abs(got[k][1] - s) < 2e-6 for k, s in enumerate(near().max(axis=1)))
    assert knowledge.spherical(points.filter("false"), 6).count() == 0


def test_vectors_without_clusters_meet_in_tiles(spark, monkeypatch):
    """At a low cosine a vector would be a guest of all cells; it goes to as many tiles as its scope has blocks."""
    monkeypatch.setattr(s, "CELL", 10)
    monkeypatch.setattr(s, "WIDE", 50)
    monkeypatch.setattr(s, "STRIP", 7)
    monkeypatch.setattr(s, "_celled", None)  # is not called
    x, scope = np.random.default_rng(11).normal(size=(300, 32)), np.arange(300) % 2
    got = [(r.a, r.b) for r in s.near_pairs(frame(spark, x, scope), 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(x, 0.3, scope) and len(got) > 100


def test_clustered_vectors_still_go_to_cells(spark, small_cells, monkeypatch):
    monkeypatch.setattr(s, "WIDE", 20)
    x = clustered(seed=12, groups=40, size=12, d=24, noise=0.02)
    called, plain = [], s._celled
    monkeypatch.setattr(s, "_celled", lambda *a: called.append(1) or plain(*a))
    got = {(r.a, r.b) for r in s.near_pairs(frame(spark, x), 0.97).collect()}
    assert called and got == plain_pairs(x, 0.97)


def test_planes_between_many_centres_take_little_memory():
    import tracemalloc

    r = np.random.default_rng(13)
    x, c = r.normal(size=(100, 64)), r.normal(size=(600, 64))
    tracemalloc.start()
    s.guests(x, c, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * 600 * 8 * 8  # some matrices of centres by centres, not one more for each component


def test_linkage_of_copies_takes_few_rounds(spark, monkeypatch):
    """Copies are one cluster from the start; in the order of pairs they would merge one a round."""
    monkeypatch.setattr(s, "WIDE", 16)
    x = np.repeat(clustered(seed=14, groups=4, size=3, d=6, noise=0.3), 20, axis=0)
    got = {r.id: r.cluster for r in s.average_linkage(frame(spark, x), 0.88, most_rounds=12).collect()}
    first = plain_linkage(x[::20], 0.88)
    distinct = len({tuple(v) for v in x.tolist()})
    assert distinct == 12 and len(set(got.values())) == len(set(got[k] for k in range(0, 240, 20))) and all(got[k] == got[k // 20 * 20] for k in got)
    assert len(set(first.values())) == len(set(got.values()))


def test_linkage_of_many_rounds_ends(spark, monkeypatch):
    """F8: of such a row of vectors a round merges one pair, and more than 200 rounds were an error; tasks make them where they can."""
    n = 230
    low = np.zeros((n, n))
    for k in range(1, n):  # each one is as near to all before it, less so the later it comes
        low[k, :k] = low[:k, k] = 0.9 - 0.003 * k
    x = np.linalg.cholesky(low + np.eye(n))
    assert {r.cluster for r in s.average_linkage(frame(spark, x), 0.05).collect()} == {0}
    monkeypatch.setattr(s, "LOCAL", 0)  # rounds of tables
    some = np.random.default_rng(4).normal(size=(60, 3))
    rounds = {r.id: r.cluster for r in s.average_linkage(frame(spark, some), 0.6).collect()}
    monkeypatch.undo()
    assert rounds == {r.id: r.cluster for r in s.average_linkage(frame(spark, some), 0.6).collect()}
    assert 1 < len(set(rounds.values())) < 30
