"""A similarity join of vectors by cells, and what rests on it: first-come dedup, average linkage.

``near_pairs`` gives every vector a home, the nearest of some trained centres. For a
vector x in the cell of centre c and a partner y with the home h the way from x to y
crosses the plane between c and h, so y lies within their distance r of it:

    (|y - c|^2 - |y - h|^2) / (2 |c - h|) <= r.

y is a guest of all cells for which that holds, and each cell compares its own vectors
with all that are there. That is exact; ``slack`` < 1 takes only guests within slack * r
and so loses some pairs (the tests measure how many). Cells of more than a block are cut
to tiles, so that no task holds a whole crowded one. Where the vectors have no clusters or
``least`` is low, a vector would be a guest of most cells, and all of them together would
hold the square of the vectors: a sample tells, and then the blocks of a scope meet
directly, each vector in as many tiles as its scope has blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.session import dropped, freed, saved, small, stored

#: Vectors that centres are learnt from at most, vectors a cell should hold, centres at most, vectors of a block.
SAMPLE, CELL, CENTRES, BLOCK = 8192, 512, 2048, 1024
#: Vectors of a block where cells would not divide the vectors, rows of scores that are held at once.
WIDE, STRIP = 4096, 512
#: Clusters of a scope that one task merges to the end.
LOCAL = 8192
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])


def usable(points: DataFrame) -> DataFrame:
    """(id, scope, v) of points (id, embedding[, scope]) with a direction: no null or non-finite component, not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    scope = F.col("scope").cast("string") if "scope" in points.columns else F.lit("")
    rows = points.select(F.col("id").cast("long").alias("id"), scope.alias("scope"), v.alias("v"), fine.alias("fine"))
    return rows.filter("fine AND id IS NOT NULL AND scope IS NOT NULL").drop("fine")


def _units(column: pa.ChunkedArray, n: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``k`` centres of unit rows by Lloyd rounds; empty ones stay."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        for j in np.unique(at):
            c[j] = x[at == j].mean(axis=0)
    return c


def guests(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and a matrix of the cells it is in: its home and all planes within ``reach``."""
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T
    home = d.argmin(axis=1)
    own = (c * c).sum(axis=1)
    apart = np.sqrt(np.maximum(own[:, None] + own - 2 * c @ c.T, 0)) + 1e-7  # what the products may lose
    inside = d - d[np.arange(len(x)), home][:, None] <= 2 * apart[home] * reach + 1e-9
    inside[np.arange(len(x)), home] = True
    return home, inside


def _learnt(rows: DataFrame, counts: dict[int, int], reach: float) -> dict[int, tuple[np.ndarray, float]]:
    """Centres for each size of vectors, and in how many cells a vector is on the average (of a sample)."""
    learnt = {}
    for d, n in counts.items():  # sizes of vectors are few
        share = min(1.0, SAMPLE / n)
        own = rows.filter((F.col("d") == d) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
        x = np.array([r["v"] for r in own.orderBy("id").select("v").limit(2 * SAMPLE).collect()], float).reshape(-1, d)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        few = x[:: max(1, len(x) // 512)]
        centres = centres_of(x, max(1, min(CENTRES, len(x), -(-n // CELL))), rounds=1)
        mean = float(guests(few, centres, reach)[1].sum() / max(1, len(few)))
        if mean < len(centres):  # finer ones may help
            centres = centres_of(x, len(centres))
            mean = float(guests(few, centres, reach)[1].sum() / max(1, len(few)))
        learnt[d] = centres, mean
    return learnt


def _celled(rows: DataFrame, learnt: dict[int, np.ndarray], reach: float) -> DataFrame:
    """(id, scope, v, d, cell, home): a row for each cell that a vector is in."""
    shared = rows.sparkSession.sparkContext.broadcast(learnt)

    def run(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                own = batch.take(pa.array(np.flatnonzero(size == d)))
                home, inside = guests(_units(own.column("v"), own.num_rows), shared.value[int(d)], reach)
                at, cell = np.nonzero(inside)
                for k in range(0, len(at), 10_000):
                    part = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(at[part])).columns, pa.array(cell[part], pa.int32()), pa.array(home[at[part]] == cell[part])], names=[*own.schema.names, "cell", "home"])

    return rows.mapInArrow(run, "id long, scope string, v array<double>, d int, cell int, home boolean")


def near_pairs(points: DataFrame, least: float, slack: float = 1.0) -> DataFrame:
    """(a, b, score) of points (id, embedding[, scope]) with a < b, one scope, one size and a cosine of ``least`` or more.

    ``slack`` 1 is exact, see above. Vectors without a direction, null ids and null scopes
    have no partner. Ids must be unique: give ``distinct_vectors`` first where copies abound,
    as all pairs that are near are put out. The cosine is rounded to nine digits before it is compared.
    """
    r = float(np.sqrt(max(0.0, 2 - 2 * (least - 1e-9))))
    rows = saved(usable(points).withColumn("d", F.size("v")))
    sizes = rows.groupBy("scope", "d").agg(F.count("*").alias("n")).groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares")).collect()
    learnt = _learnt(rows, {x["d"]: x["n"] for x in sizes}, slack * r)
    # a vector goes to one cell for each block of its scope if it would go to more cells than that
    open_ = [x["d"] for x in sizes if learnt[x["d"]][1] >= max(1.0, x["squares"] / x["n"] / WIDE)]
    parts = []
    if open_:
        parts.append(_tiled(rows.filter(F.col("d").isin(open_)).withColumns({"cell": F.lit(0), "home": F.lit(True)}), least, WIDE, True))
    if len(open_) < len(sizes):
        found = _tiled(_celled(rows.filter(~F.col("d").isin(open_)), {d: c for d, (c, _) in learnt.items() if d not in open_}, slack * r), least, BLOCK, max((x["most"] for x in sizes), default=0) > BLOCK)
        parts.append(found.groupBy("a", "b").agg(F.max("score").alias("score")))  # a pair may meet in both homes
    if not parts:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _tiled(placed: DataFrame, least: float, width: int, crowded: bool) -> DataFrame:
    """Near pairs (a, b, score) of the rows of each cell, in tiles of two blocks of about ``width`` rows."""
    key = ["scope", "d", "cell"]
    if crowded:
        blocks = placed.groupBy(*key).agg(F.ceil(F.count("*") / width).cast("int").alias("blocks")).filter("blocks > 1")
        placed = placed.join(small(saved(blocks)), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        placed = placed.withColumn("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # a tile is a block of a cell's rows beside another block of them; a row goes to all tiles of its block
    tiles = placed.select("*", block.alias("block")).select("*", others)
    tiles = tiles.select(*key, "id", "v", "home", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def compare(group: pa.Table) -> pa.Table:
        n = group.num_rows
        block, home = group.column("block").to_numpy(), group.column("home").to_numpy()
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        one, two = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if n < 2 or not len(one) or not len(two):
            return _PAIR.empty_table()
        x, ids = _units(group.column("v"), n), group.column("id").to_numpy()
        right, found = x[two], []
        for k in range(0, len(one), STRIP):  # a strip of scores at a time
            own = one[k : k + STRIP]
            score = x[own] @ right.T
            i, j = np.nonzero(score >= least - 1e-8)
            s = np.round(score[i, j], 9)
            a, b = own[i], two[j]
            fits = (s >= least) & (home[a] | home[b]) & ((ids[a] < ids[b]) if first == second else (ids[a] != ids[b]))
            a, b = ids[a[fits]], ids[b[fits]]
            found.append(pa.table([np.minimum(a, b), np.maximum(a, b), s[fits]], schema=_PAIR))
        return pa.concat_tables(found)

    return tiles.groupBy(*key, "first", "second").applyInArrow(compare, "a long, b long, score double")


def distinct_vectors(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) and one point (id, scope, embedding, n) for all equal vectors of a scope, under their least id."""
    rows = usable(points).withColumn("h", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))
    classes = saved(rows.groupBy("scope", "h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("embedding")))
    members = rows.select("id", "scope", "h").join(classes.select("scope", "h", "rep"), ["scope", "h"]).select("id", "rep")
    return members, classes.select(F.col("rep").alias("id"), "scope", "embedding", "n")


def first_kept(pairs: DataFrame, nodes: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, keeper): which nodes (id, place) a first-come pass keeps (keeper = id), and the first kept one near each other.

    The pass goes through the nodes by place and keeps one if no kept one is its partner
    in ``pairs`` (a, b). A node is settled as soon as all its partners before it are: kept
    if none of them is, else dropped. Nodes that can be settled are, all at once, in rounds.
    """
    place = nodes.select("id", "place")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(place.withColumnsRenamed({"id": "a", "place": "pa"}), "a").join(place.withColumnsRenamed({"id": "b", "place": "pb"}), "b")
    before = saved(ends.filter(F.struct("pa", "a") < F.struct("pb", "b")).select("a", "b", "pa"))  # a comes before b
    kept = dropped = None
    left = before
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        late = left.select(F.col("b").alias("a")).distinct()
        # those that wait for nobody are kept, whoever comes after them goes
        new = saved(left.select("a").distinct().join(late, "a", "left_anti"))
        gone = saved(left.join(new, "a", "left_semi").select("b").distinct())
        kept = new if kept is None else kept.unionByName(new)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        out = gone.withColumnRenamed("b", "x")
        left = left.join(new, "a", "left_anti")
        left = left.join(out, left["a"] == out["x"], "left_anti").join(out, left["b"] == out["x"], "left_anti")
        left = saved(left)
    else:
        raise RuntimeError("the pass did not settle")
    if dropped is None:
        return place.select("id", F.col("id").alias("keeper"))
    settled = place.join(dropped.select(F.col("b").alias("id")), "id", "left_anti").select(F.col("id").alias("a"))
    keeper = before.join(settled, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("pa", "a"))["a"].alias("keeper"))
    keeper = keeper.join(dropped.select(F.col("b").alias("id")), "id", "left_semi")
    return place.join(keeper, "id", "left").select("id", F.coalesce("keeper", "id").alias("keeper"))


def average_linkage(points: DataFrame, least: float, most_rounds: int | None = None) -> DataFrame:
    """(id, cluster) of points (id, embedding[, scope]): agglomeration while the mean cosine of two clusters is over ``least``.

    The mean cosine of two clusters is the product of their sums of unit vectors by their
    sizes. Vectors of one direction (twelve digits) are one cluster from the start. Two clusters
    that are each other's nearest merge, all such at once in a round; as a merged cluster is
    never nearer to a third than the nearer of its parts was, that gives the clusters of merging
    one pair after another, and a cluster with none over ``least`` is done. A round sends the sums to
    tiles of two blocks of a scope, of which only each one's nearest comes back, and merges one pair at least; when no scope
    has more than ``LOCAL`` clusters left, a task makes the other rounds of each. A cluster is named by its least id.
    """
    unit = usable(points).withColumn("m", F.array_max(F.transform("v", F.abs))).withColumn("v", F.transform("v", lambda x: x / F.col("m")))
    unit = unit.withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))).select("id", "scope", F.size("v").alias("d"), F.transform("v", lambda x: x / F.col("s")).alias("v"))
    unit = saved(unit.withColumn("h", F.sha2(F.array_join(F.transform("v", lambda x: (F.round(x, 12) + F.lit(0.0)).cast("string")), ",").cast("binary"), 256)))
    same = unit.groupBy("scope", "d", "h").agg(F.min("id").alias("c"), F.count("*").alias("n"), F.first("v").alias("v"))
    ties = [unit.join(same.select("scope", "d", "h", "c"), ["scope", "d", "h"]).filter("id <> c").select(F.col("c").alias("src"), F.col("id").alias("dst"))]
    clusters = stored(same.select("c", F.lit(None).cast("long").alias("gone"), "scope", "d", F.transform("v", lambda x: x * F.col("n")).alias("v"), "n"))
    member = points.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL")
    rounds = 0
    while True:
        crowd = clusters.groupBy("scope", "d").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if crowd <= LOCAL:
            ties.append(stored(clusters.drop("gone").groupBy("scope", "d").applyInArrow(_merged(least), "src long, dst long")))
            break
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError("the clusters did not settle")
        nearest = _nearest(clusters, least, crowd).withColumnRenamed("x", "c")
        own = clusters.drop("gone").join(nearest, "c").groupBy("a", "b").agg(F.count("*").alias("k"), F.collect_list(F.struct("c", "scope", "d", "v", "n")).alias("r"))  # two at most
        one, two, both = F.col("r")[0], F.get("r", F.lit(1)), F.col("k") == 2
        before, clusters = clusters, stored(own.select(
            F.when(both, F.col("a")).otherwise(one["c"]).alias("c"), F.when(both, F.col("b")).alias("gone"), one["scope"].alias("scope"), one["d"].alias("d"),
            F.when(both, F.zip_with(one["v"], two["v"], lambda x, y: x + y)).otherwise(one["v"]).alias("v"), F.when(both, one["n"] + two["n"]).otherwise(one["n"]).alias("n"),
        ))
        dropped(before)
        merged = stored(clusters.filter("gone IS NOT NULL").select(F.col("c").alias("src"), F.col("gone").alias("dst")))
        if merged.isEmpty():
            break
        ties.append(merged)
        if len(ties) > 16:
            ties = [stored(_all(ties))]
        del nearest, own
        freed(points.sparkSession)
    dropped(clusters)
    found = graph.components(_all(ties)).withColumnRenamed("node", "id")
    return member.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _merged(least: float):
    """A function of the clusters (c, v, n) of a scope: (src, dst) of all merges, in the rounds of ``average_linkage``.

    A cluster looks for its nearest one anew only when that one, or itself, has merged.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, n = group.column("c").to_numpy(), group.column("n").to_numpy().astype(float)
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        mean = v / n[:, None]
        near, left, stale, ties = np.full(len(ids), -1), np.arange(len(ids)), np.arange(len(ids)), []
        while len(stale):
            place = np.full(len(ids), -1)
            place[left] = np.arange(len(left))
            right, done = mean[left], np.zeros(len(ids), bool)
            for k in range(0, len(stale), STRIP):
                own = stale[k : k + STRIP]
                score = np.round(mean[own] @ right.T, 9)
                score[np.arange(len(own)), place[own]] = -np.inf
                at = score.argmax(axis=1)
                near[own], done[own] = left[at], score[np.arange(len(own)), at] <= least
            left = left[~done[left]]
            a = left[(near[near[left]] == left) & (left < near[left]) & ~done[near[left]]]
            b = near[a]
            ties.append(pa.table({"src": ids[a], "dst": ids[b]}))
            v[a] += v[b]
            n[a] += n[b]
            mean[a] = v[a] / n[a][:, None]
            moved = np.zeros(len(ids), bool)
            moved[a] = moved[b] = True
            gone = done
            gone[b] = True
            left = left[~gone[left]]
            stale = left[moved[left] | moved[near[left]] | gone[near[left]]] if len(a) else left[:0]
        return pa.concat_tables(ties)

    return run


def _nearest(clusters: DataFrame, least: float, crowd: int) -> DataFrame:
    """(x, a, b) of clusters (c, scope, d, v, n): each one x in the pair with its nearest one over ``least``, the least one on ties."""
    key = ["scope", "d"]
    if crowd > WIDE:
        blocks = clusters.groupBy(*key).agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks"))
        placed = clusters.join(small(blocks), key)
    else:
        placed = clusters.withColumn("blocks", F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = placed.select(*key, "c", "v", "n", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("c").to_numpy()
        order = np.argsort(ids)
        block, ids = group.column("block").to_numpy()[order], ids[order]
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        v = v / group.column("n").to_numpy()[order][:, None]
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        one, two = np.flatnonzero(block == first), np.flatnonzero(block == second)
        out = []
        for own, others in ([(one, two)] if first == second else [(one, two), (two, one)]):
            right = v[others]
            for k in range(0, len(own) if len(others) else 0, STRIP):
                part = own[k : k + STRIP]
                score = np.round(v[part] @ right.T, 9)
                if first == second:
                    score[np.arange(len(part)), np.arange(k, k + len(part))] = -np.inf
                at = score.argmax(axis=1)
                best = score[np.arange(len(part)), at]
                fits = best > least
                out.append(pa.table({"x": ids[part][fits], "y": ids[others[at]][fits], "s": best[fits]}))
        return pa.concat_tables(out) if out else pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})

    found = tiles.groupBy(*key, "first", "second").applyInArrow(compare, "x long, y long, s double")
    best = found.groupBy("x").agg(F.min(F.struct((-F.col("s")).alias("o"), "y"))["y"].alias("y"))
    return best.select("x", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of all ends of pairs (a, b)."""
    return graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "id")
