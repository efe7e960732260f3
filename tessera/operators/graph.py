"""Property-graph operators over edge tables (src, dst, ...), iterated as DataFrame jobs.

Iterations write their state to the shared folder of ``spark.checkpoint.dir`` by
``checkpoint()``, so that the plan stays short and lost executors can be replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import BROADCAST_ROWS, dropped, freed, saved, small, stored

#: A partition's size beside the mean from which a key counts as hot, in tables of more than ``FEW`` rows.
HOT, FEW = 4, 100_000
#: Neighbours that a list of one node should hold at most.
PIECE = 1 << 16
#: Seeds of one search: bits of a number.
SEEDS = 62
#: Ways of a component that one task may hold, ways up to which components share a task, steps along ways of a task, tasks at most
#: (besides one for each component), rows of one block of seeds where a component is larger than a task.
WAYS, FEW_WAYS, STEPS, TASKS, SEARCHED = 4_000_000, 50_000, 3_000_000_000, 500, 20_000_000
#: Ways of a block of ranked nodes.
RANKED = 1_000_000
#: Ways of two steps from the nodes of a block, nodes of it at most, numbers of a list sent at once, numbers sent in one pass.
STEPPED, BLOCK_NODES, SLICE, SENT = 1 << 23, 1024, 4096, 400_000_000
#: Seeds that a task searches from together, numbers of them and all nodes at most, ways that it sums at once.
TOGETHER, CELLS, STRIP = 32, 1 << 21, 4096


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops."""
    pair = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pair.select(F.explode(ways).alias("w")).select("w.src", "w.dst")


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, in either direction."""
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): the least number of steps to every node within ``hops``."""
    step = undirected(edges)
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        near = front.join(step, front["node"] == step["src"]).select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hop")).distinct()
        front = saved(near.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "hop"))
        seen = seen.unionByName(front)
    return seen


def by_node(df: DataFrame, key: str) -> DataFrame:
    """Saved in a number of hash partitions, fixed by its rows, of ``key``, so that rounds of joins on it don't shuffle it again.

    An adaptive plan doesn't tell how its rows are dealt, so this one checkpoint is made by a plain one.
    Where one key would make its partition ``HOT`` times the mean, the rows are saved as they
    are: each join then shuffles them, and adaptive execution splits what is skewed.
    """
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before, n = conf.get(adaptive), int(conf.get("spark.sql.shuffle.partitions"))
    rows = saved(df)
    total, most = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if total and most * n > HOT * total and total > FEW:
        return rows
    conf.set(adaptive, "false")
    try:
        return saved(rows.repartition(n, key))
    finally:
        conf.set(adaptive, before)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Rank of each node after ``rounds`` rounds; the mass of nodes without a way out is shared by all.

    Ways are lists of numbers in blocks of nodes near in number. A round sums up in each block what goes to each node
    and shuffles the lists and these sums; its ranks are a table, and the shuffles of the round before are freed.
    """
    spark = edges.sparkSession
    rows, names = _numbers(edges)
    rows = rows.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    lists = stored(rows.groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("nums")))
    freed(spark)
    total = lists.agg(F.sum(F.size("nums"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(lists.repartitionByRange(max(1, min(2 * parts, total // 10_000), total // RANKED), "node").withColumn("block", F.spark_partition_id()))
    dropped(lists)
    ends = dealt.select(F.explode("nums").alias("node")).distinct()
    nodes = stored(dealt.select("node", "block").join(ends, "node", "full_outer"))
    n, n_ends = nodes.agg(F.count("*"), F.count_if(F.col("block").isNull())).first()
    ranks = stored(nodes.withColumn("rank", F.lit(1.0 / max(n, 1))))
    freed(spark)
    for _ in range(rounds if n else 0):
        lost = (ranks.filter("block IS NULL").agg(F.sum("rank")).first()[0] or 0.0) if n_ends else 0.0
        own = ranks.filter("block IS NOT NULL").select("node", "block", "rank")
        sent = dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_sent, "node long, got double").groupBy("node").agg(F.sum("got").alias("got"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        before, ranks = ranks, stored(nodes.join(sent, "node", "left").select("node", "block", rank.alias("rank")))
        dropped(before)
        if total > BROADCAST_ROWS:
            del own, sent
            freed(spark)
    dropped(dealt, nodes)
    if names is None:
        return ranks.select(F.col("node").cast(edges.schema["src"].dataType).alias("node"), "rank")
    return ranks.withColumnRenamed("node", "num").join(names, "num").select("node", "rank")


def _sent(lists: pa.Table, ranks: pa.Table) -> pa.Table:
    """(node, got): what a block's ways (node, nums) carry to each node, equal shares of ranks (node, rank)."""
    if not lists.num_rows:
        return pa.table({"node": pa.array([], pa.int64()), "got": pa.array([], pa.float64())})
    ids, rank = ranks.column("node").to_numpy(), ranks.column("rank").to_numpy()
    order = np.argsort(ids)
    nums = lists.column("nums").combine_chunks()
    size = pa.compute.list_value_length(nums).to_numpy()
    own = rank[order][np.searchsorted(ids[order], lists.column("node").to_numpy())]
    to, share = nums.flatten().to_numpy(), np.repeat(own / size, size)
    least = to.min()
    if int(to.max()) - int(least) < 8 * len(to):
        sums = np.bincount(to - least, share)
        nodes = np.flatnonzero(sums)  # shares are over 0
        nodes, got = nodes + least, sums[nodes]
    else:
        nodes, at = np.unique(to, return_inverse=True)
        got = np.bincount(at, share)
    return pa.table({"node": pa.array(nodes, pa.int64()), "got": pa.array(got, pa.float64())})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable.

    A round ties every node's larger neighbours to its least one, then its smaller ones, so
    edges melt into stars around the least nodes; a count and two checksums of the edges,
    one aggregate, tell when nothing moves any more. Each round works on what edges are left.
    """
    pair = edges.filter("src <> dst")
    stars = stored(pair.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m"))
        up = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, stored(down.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        dropped(before)
        if now[0] > BROADCAST_ROWS:
            del both, nearest, up, lowest, down
            freed(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities by synchronous label propagation: the most frequent label nearby, the least on ties.

    Rounds work on numbers in the nodes' order.
    """
    pair = stored(edges.filter("src <> dst").select("src", "dst").distinct())
    names = stored(numbered(pair.select(F.col("src").alias("node")).unionByName(pair.select(F.col("dst").alias("node")))))
    known = small(names)
    ways = pair.join(known.withColumnsRenamed({"node": "src", "num": "a"}), "src").join(known.withColumnsRenamed({"node": "dst", "num": "b"}), "dst")
    step = by_node(undirected(ways.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "dst")
    labels = names.select(F.col("num").alias("node"), F.col("num").alias("community"))
    for _ in range(rounds):
        votes = step.join(labels, step["dst"] == labels["node"]).groupBy(F.col("src").alias("n"), "community").agg(F.count("*").alias("c"))
        best = votes.groupBy("n").agg(F.min(F.struct((-F.col("c")).alias("o"), "community"))["community"].alias("community"))
        labels = saved(best.select(F.col("n").alias("node"), "community"))
    out = labels.join(known.withColumnsRenamed({"node": "name", "num": "node"}), "node").drop("node")
    return out.join(known.withColumnsRenamed({"node": "label", "num": "community"}), "community").select(F.col("name").alias("node"), F.col("label").alias("community"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree 2E/N, density E / (N (N - 1) / 2)."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).agg(F.count_distinct("node").alias("n_nodes"))
    counts = edges.select("src", "dst").distinct().agg(F.count("*").alias("n_edges"))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return nodes.crossJoin(counts).select(  # one row each
        "n_nodes", "n_edges", F.round(2 * e / n, 6).alias("avg_degree"), F.round(e / (n * (n - 1) / 2), 6).alias("density")
    )


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, num): distinct nodes with numbers in their order."""
    return saved(nodes.select("node").distinct().orderBy("node")).withColumn("num", F.monotonically_increasing_id())


def beside(own: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, num): for every way of own (node, via) and ends (via, num) a row; dealt by node.

    What is shuffled is one list of numbers for each row of ``own``, not the pairs; what
    is then grouped by node, and by node and number, is not shuffled again.
    """
    lists = ends.groupBy("via").agg(F.sort_array(F.collect_list("num")).alias("nums"))
    return own.join(lists, "via").select("node", "nums").repartition("node").select("node", F.explode("nums").alias("num"))


def _numbers(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges (src, dst) with whole numbers as nodes, and (node, num) in the nodes' order where they were others."""
    edges = edges.select("src", "dst")
    if edges.schema["src"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), None
    names = stored(numbered(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))))
    known = small(names)
    rows = edges.join(known.withColumnsRenamed({"node": "src", "num": "a"}), "src").join(known.withColumnsRenamed({"node": "dst", "num": "b"}), "dst")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst")), names


def two_steps(one: DataFrame, back: DataFrame, out, schema: str) -> DataFrame:
    """What ``out`` makes of the ways from each node by one (node, via) and back (via, node), distinct rows of whole numbers.

    Nodes near in number form a block. A via's list goes to each block once, and pairs are made and counted in the block's
    task. Where lists to all blocks would be more than ``SENT`` numbers, parts of the blocks follow one another, each of
    which frees its shuffles. ``out`` gets (own, other, count, node, via) of whole blocks as arrays, sorted by own, and gives a table.
    """
    spark = one.sparkSession
    lists = stored(back.groupBy("via").agg(F.collect_list("node").alias("nums")))
    nodes = stored(numbered(one.select("node")))
    n, ways = nodes.count(), lists.agg(F.sum(F.size("nums").cast("double") * F.size("nums"))).first()[0] or 0.0
    freed(spark)
    width = max(1, min(BLOCK_NODES, int(STEPPED * n / max(ways, 1.0))))
    block = nodes.select("node", F.floor(F.col("num") / width).alias("block"))
    own = stored(one.join(small(block), "node").groupBy("via", "block").agg(F.collect_list("node").alias("own")))
    freed(spark)
    sent = own.join(lists.select("via", F.size("nums").alias("n")), "via").agg(F.sum("n")).first()[0] or 0
    passes, parts = max(1, -(-sent // SENT)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = min(2000, max(parts, -(-n // width // passes)))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("nums") - 1) / SLICE)), lambda k: F.slice("nums", (k * SLICE + 1).cast("int"), SLICE))
    found = None
    for k in range(passes):
        rows = own.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == k).join(lists, "via").select("block", "via", "own", F.explode(slices).alias("nums"))
        rows = rows.repartition(deal, "block").sortWithinPartitions("block")
        part = stored(rows.mapInArrow(_counted(out), schema))
        found = part if found is None else found.unionByName(part)
        del rows
        freed(spark)
    dropped(lists, own, nodes)
    return found


def _counted(out):
    """A function of batches (block, via, own, nums) in the order of their blocks: ``out`` of each block's counted pairs."""

    def pairs(batch):
        own, nums = batch.column("own"), batch.column("nums")
        k, m = np.asarray(pa.compute.list_value_length(own)), np.asarray(pa.compute.list_value_length(nums))
        nodes, oi = np.unique(own.flatten().to_numpy(), return_inverse=True)
        others, ni = np.unique(nums.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(k)), k)
        size, first = m[row], (np.cumsum(m) - m)[row]
        ends, a = np.cumsum(size), 0
        found = []
        while a < len(row):  # pairs of some rows at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEPPED, "right")))
            s = size[a:b]
            at = np.arange(s.sum()) + np.repeat(first[a:b] - np.cumsum(s) + s, s)
            key = np.repeat(oi[a:b] * len(others), s) + ni[at]
            if len(nodes) * len(others) <= 2 * STEPPED:
                n = np.bincount(key)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            found.append((nodes[key // len(others)], others[key % len(others)], n))
            a = b
        return found, (own.flatten().to_numpy(), np.repeat(batch.column("via").to_numpy(), k))

    def merged(found):
        own, other, n = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((other, own))
        own, other, n = own[order], other[order], n[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (other[1:] != other[:-1])))
        return own[first], other[first], np.add.reduceat(n, first)

    def run(batches):
        now, found, ways = None, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for a, b in zip(cuts, [*cuts[1:], len(blocks)]):
                if found and blocks[a] != now:
                    yield from out(*merged(found), *(np.concatenate(x) for x in zip(*ways))).to_batches(10_000)
                    found, ways = [], []
                now = blocks[a]
                new, way = pairs(batch.slice(a, b - a))
                found += new
                ways.append(way)
                if sum(len(x[0]) for x in found[1:]) > STEPPED:
                    found = [merged(found)]
        if found:
            yield from out(*merged(found), *(np.concatenate(x) for x in zip(*ways))).to_batches(10_000)

    return run


def _best_shared(most: int | None):
    """(node, other, common) without direct neighbours: all, or those that have as many as the ``most``-th of their node."""

    def out(own, other, n, node, via):
        fits = own != other
        own, other, n = own[fits], other[fits], n[fits]
        # direct neighbours are those by which the ways lead
        order = np.lexsort((via, node))
        near, names = np.stack([node[order], via[order]], axis=1), np.unique(np.concatenate([via, other]))
        ids = np.unique(node)
        key = np.searchsorted(ids, own) * len(names) + np.searchsorted(names, other)
        fits = ~np.isin(key, np.searchsorted(ids, near[:, 0]) * len(names) + np.searchsorted(names, near[:, 1]))
        own, other, n = own[fits], other[fits], n[fits]
        if most is not None and len(own):
            order = np.lexsort((-n, own))
            own, other, n = own[order], other[order], n[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            last = np.minimum(first + most, np.append(first[1:], len(own))) - 1
            fits = n >= np.repeat(n[last], np.diff(np.append(first, len(own))))
            own, other, n = own[fits], other[fits], n[fits]
        return pa.table({"node": pa.array(own, pa.int64()), "other": pa.array(other, pa.int64()), "common": pa.array(n, pa.int64())})

    return out


def _listed(piece: int):
    """(node, nums): all others of a node in lists of at most ``piece``."""

    def out(own, other, n, node, via):
        fits = own != other
        own, other = own[fits], other[fits]
        change = np.append(True, own[1:] != own[:-1])[: len(own)]
        first = np.flatnonzero(change)
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        cut = np.flatnonzero(place % piece == 0)
        return pa.table({"node": pa.array(own[cut], pa.int64()), "nums": pa.ListArray.from_arrays(pa.array(np.append(cut, len(own)), pa.int32()), pa.array(other, pa.int64()))})

    return out


def shared_neighbours(edges: DataFrame, seeds: DataFrame, most: int | None = None, name=F.col) -> DataFrame:
    """(node, other, common): nodes two steps from a seed that are no direct neighbours, by common neighbours.

    ``most`` keeps each seed's first ones by common neighbours, the least ``name`` of a column on ties, which is also put out.
    """
    rows, names = _numbers(edges)
    known = seeds.select("node").distinct()
    if names is not None:
        known = known.join(small(names), "node").select(F.col("num").alias("node"))
    step = stored(undirected(rows))
    freed(edges.sparkSession)
    one = step.join(small(known.withColumnRenamed("node", "src")), "src").select(F.col("src").alias("node"), F.col("dst").alias("via"))
    back = step.select(F.col("src").alias("via"), F.col("dst").alias("node")).join(small(one.select("via").distinct()), "via", "left_semi")
    counts = two_steps(one, back, _best_shared(most), "node long, other long, common long")
    dropped(step)
    label = F.col if names is not None else name
    if most is not None:
        w = Window.partitionBy("node").orderBy(F.desc("common"), label("other"))  # numbers are in the nodes' order
        counts = counts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    if names is None:
        return counts.select(name("node").alias("node"), name("other").alias("other"), "common")
    counts = counts.join(small(names.withColumnsRenamed({"node": "_n", "num": "node"})), "node").join(small(names.withColumnsRenamed({"node": "_o", "num": "other"})), "other")
    return counts.select(F.col("_n").alias("node"), F.col("_o").alias("other"), "common")


def levels(edges: DataFrame, seeds: DataFrame, most: int = 100) -> DataFrame:
    """(seed, node, hop): steps along edges (src to dst) from every seed to every node it reaches."""
    step = by_node(edges.filter("src <> dst").select("src", "dst").distinct(), "src")
    seen = saved(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")))
    front = seen
    for hop in range(1, most + 1):
        near = front.join(step, front["node"] == step["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = saved(near.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = saved(seen.unionByName(front))
    raise RuntimeError("the search did not end")


def closeness(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, closeness) of the seeds, over ways that lead to them: (r / total steps) * (r / (n - 1)).

    ``r`` counts the other nodes that reach the seed; seeds that none reaches have 0. Up to ``SEEDS``
    seeds are searched from at once: a node has one row with a bit for each seed that it has met.
    """
    back = by_node(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "src")
    nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct().count()
    names = [x["node"] for x in seeds.select("node").distinct().orderBy("node").collect()]  # a chosen set
    kind, out = edges.schema["src"].dataType.simpleString(), []
    for at in range(0, len(names), SEEDS):
        own = names[at : at + SEEDS]
        steps, r = [0] * len(own), [0] * len(own)
        seen = saved(edges.sparkSession.createDataFrame([(x, 1 << k) for k, x in enumerate(own)], f"node {kind}, met long"))
        front, hop = seen, 0
        while True:
            hop += 1
            near = front.join(back, front["node"] == back["src"]).groupBy(F.col("dst").alias("node")).agg(F.bit_or("met").alias("met"))
            both = near.withColumnRenamed("met", "now").join(seen, "node", "full_outer").select("node", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("now", "met")])
            both = saved(both.select("node", F.col("now").bitwiseAND(F.bitwise_not("met")).alias("new"), F.col("now").bitwiseOR(F.col("met")).alias("met")))
            found = both.agg(*[F.count_if(F.getbit("new", F.lit(k)) == 1).alias(f"s{k}") for k in range(len(own))]).first()
            if not any(found):
                break
            for k, n in enumerate(found):
                steps[k], r[k] = steps[k] + hop * n, r[k] + n
            seen, front = both.select("node", "met"), both.filter("new <> 0").select("node", F.col("new").alias("met"))
        out += [(x, r[k] / steps[k] * r[k] / max(nodes - 1, 1) if steps[k] and nodes > 1 else 0.0) for k, x in enumerate(own)]
    return edges.sparkSession.createDataFrame(out, f"node {kind}, closeness double")


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, centrality): x + sum of x over incoming neighbours, scaled to length one, until it rests; 0 for all if it does not."""
    names = numbered(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))))
    n = names.count()
    a, b = small(names.withColumnsRenamed({"node": "src", "num": "a"})), small(names.withColumnsRenamed({"node": "dst", "num": "b"}))
    ways = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    piece = F.pmod(F.xxhash64("b"), F.lit(max(1, -(-n // PIECE))))
    lists = saved(ways.groupBy(F.col("a").alias("node"), piece.alias("_p")).agg(F.collect_list("b").alias("nums")).select("node", "nums"))
    return _rested(lists, names, n, rounds, tolerance)


def partner_eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``eigenvector`` of the graph that ties each two ``src`` of edges (src, dst) with a common ``dst``.

    The graph is held as lists of numbers by node; its pairs are made where they are
    grouped (``two_steps``) and are never shuffled. A node that shares nothing is not there.
    """
    known = edges.schema["src"].dataType.simpleString() in ("int", "bigint")
    own = edges.select(F.col("src").alias("node"), F.col("dst").alias("via")).filter("node IS NOT NULL AND via IS NOT NULL")
    if not known:
        names = stored(numbered(own.select("node")))
        ends = stored(numbered(own.select(F.col("via").alias("node")))).withColumnsRenamed({"node": "via", "num": "_v"})
        own = own.join(small(names), "node").join(small(ends), "via").select(F.col("num").alias("node"), F.col("_v").alias("via"))
    own = stored(own.select(F.col("node").cast("long").alias("node"), F.col("via").cast("long").alias("via")).distinct())
    freed(edges.sparkSession)
    lists = two_steps(own, own.select("via", "node"), _listed(PIECE), "node long, nums array<long>")
    dropped(own)
    there = lists.select(F.col("node").alias("num")).distinct()
    names = stored(there.select(F.col("num").cast(edges.schema["src"].dataType).alias("node"), "num") if known else names.join(there, "num", "left_semi").select("node", "num"))
    return _rested(lists, names, names.count(), rounds, tolerance)


def _rested(lists: DataFrame, names: DataFrame, n: int, rounds: int, tolerance: float) -> DataFrame:
    """Power rounds over lists (node, nums) of where each node's value goes; names (node, num) are all nodes."""
    x = names.select("num", F.lit(1.0 / max(n, 1)).alias("x"))
    for _ in range(rounds):
        sent = lists.join(F.broadcast(x) if n <= BROADCAST_ROWS else x, lists["node"] == x["num"]).select(F.explode("nums").alias("to"), "x")
        got = sent.groupBy("to").agg(F.sum("x").alias("got"))
        raw = saved(x.join(got, x["num"] == got["to"], "left").select("num", F.col("x").alias("old"), (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("raw")))
        length = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("l")).first()["l"] or 1.0
        moved = raw.agg(F.sum(F.abs(F.col("raw") / length - F.col("old")))).first()[0] or 0.0
        x = raw.select("num", (F.col("raw") / length).alias("x"))
        if moved < n * tolerance:
            return names.join(x, "num").select("node", F.col("x").alias("centrality"))
    return names.select("node", F.lit(0.0).alias("centrality"))


def betweenness(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, score): summed shares of shortest ways from the seeds that pass through a node; all nodes are seeds if none are given.

    With all nodes the score is exact (each pair counted once in either direction). Scores are not normalised.
    A search stays within its component: components of at most ``WAYS`` ways are sent to tasks, the seeds of a
    large one to as many as its work fills, small ones to one task together. Larger ones are searched by joins in blocks of seeds.
    """
    spark = edges.sparkSession
    nums, names = _numbers(edges.filter("src <> dst"))
    if names is not None and seeds is not None:
        seeds = seeds.select("node").distinct().join(small(names), "node").select(F.col("num").alias("node"))
    nums = nums.distinct()
    lists = stored(nums.groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("nums")))
    freed(spark)
    links = lists.select(F.col("node").alias("src"), F.explode("nums").alias("dst"))
    member = stored(components(links))
    own = lists.withColumn("seed", F.lit(True))
    if seeds is not None:
        known = seeds.select(F.col("node").cast("long").alias("node")).distinct().withColumn("seed", F.lit(True))
        own = lists.join(small(known), "node", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    own = own.join(small(member), "node")
    sizes = stored(own.groupBy("component").agg(F.sum(F.size("nums")).alias("ways"), F.count_if("seed").alias("seeds")).filter("seeds > 0").withColumn("steps", F.col("ways").cast("double") * F.col("seeds")))
    freed(spark)
    total, few, large = sizes.agg(F.sum(F.when(F.col("ways") <= WAYS, F.col("steps"))), F.sum(F.when(F.col("ways") <= FEW_WAYS, F.col("ways"))), F.count_if(F.col("ways") > WAYS)).first()
    steps, bins = max(STEPS, (total or 0) / TASKS), max(1, -(-(few or 0) // FEW_WAYS))
    key = F.xxhash64("component")  # two of one hash may share a task, as small ones do
    dealt = sizes.filter(F.col("ways") <= WAYS).select("component", F.when(F.col("ways") <= FEW_WAYS, F.pmod(key, F.lit(bins))).otherwise(key).alias("bin"), F.ceil(F.col("steps") / steps).cast("int").alias("parts"))
    tasks = dealt.groupBy("bin").agg(F.max("parts").alias("n")).agg(F.sum("n")).first()[0] or 1
    rows = own.join(small(dealt), "component").select("component", "node", "nums", "bin", F.when(F.col("seed"), F.pmod(F.xxhash64("node", F.lit(5)), "parts")).otherwise(-1).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # a stated number of partitions is not made less by adaptive execution, which sees bytes and not work
    rows = rows.repartition(int(min(2000, 4 * tasks)), "bin", "part")
    found = stored(rows.groupBy("bin", "part").applyInArrow(_shares, "node long, score double").groupBy("node").agg(F.sum("score").alias("score")))
    if large:
        crowd = member.join(small(sizes.filter(F.col("ways") > WAYS).select("component")), "component").select("node")
        big = stored(own.join(crowd, "node", "left_semi").select("node", "nums", "seed"))
        far = _searched(big.select(F.col("node").alias("src"), F.explode("nums").alias("dst")), big.filter("seed").select("node"), crowd.count())
        found = found.unionByName(far).groupBy("node").agg(F.sum("score").alias("score"))
    every = member.select("node").join(found, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
    if names is None:
        return every.select(F.col("node").cast(edges.schema["src"].dataType).alias("node"), "score")
    return every.withColumnRenamed("node", "num").join(names, "num").select("node", "score")


class _Lists:
    """Neighbours of nodes 0 to n - 1 in one array, ``starts[x]`` to ``starts[x + 1]`` those of x."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.near = dst[np.argsort(src, kind="stable")]
        self.degree = np.bincount(src, minlength=n)
        self.starts = np.concatenate([[0], np.cumsum(self.degree)])

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of ``nodes`` one after another, and where those of each begin (and the last end)."""
        starts = np.concatenate([[0], np.cumsum(self.degree[nodes])])
        return self.near[np.arange(starts[-1]) + np.repeat(self.starts[nodes] - starts[:-1], self.degree[nodes])], starts

    def sums(self, nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each of ``nodes``, all with neighbours, the sum of their rows of ``x``; a strip of ways at a time."""
        near, starts = self.of(nodes)
        out = np.zeros((len(nodes), x.shape[1]))
        for a in range(0, len(near), STRIP):
            b = min(a + STRIP, len(near))
            one, two = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            out[one:two] += np.add.reduceat(x.take(near[a:b], axis=0), np.maximum(starts[one:two] - a, 0), axis=0)
        return out

    def ahead(self, nodes: np.ndarray) -> np.ndarray:
        """All neighbours of ``nodes``, each once."""
        near = self.of(nodes)[0]
        if len(near) * 8 < len(self.degree):
            return np.unique(near)
        met = np.zeros(len(self.degree), bool)
        met[near] = True
        return np.flatnonzero(met)


def _shares(group: pa.Table) -> pa.Table:
    """(node, score) of the ways (node, nums) of whole components: shares of shortest ways from those whose ``own`` is this ``part``.

    Levels from ``TOGETHER`` seeds (columns) with their numbers of shortest ways, then shares are handed back level by level.
    """
    group = group.sort_by([("component", "ascending"), ("node", "ascending")])  # seeds of one component go together
    nums = group.column("nums").combine_chunks()
    ids, near = group.column("node").to_numpy(), nums.flatten().to_numpy()
    size = pa.compute.list_value_length(nums).to_numpy()
    nodes = np.unique(np.concatenate([ids, near]))
    n, at = len(nodes), np.searchsorted(nodes, ids)
    src, dst = np.repeat(at, size), np.searchsorted(nodes, near)
    out, back = _Lists(n, src, dst), _Lists(n, dst, src)
    wide = max(1, min(TOGETHER, CELLS // n))
    hop, ways, part, x = np.full((n, wide), -1, np.int32), *(np.zeros((n, wide)) for _ in range(3))  # x: what is summed, else 0
    score = np.zeros(n)
    seeds = at[group.column("own").to_numpy() == group.column("part")[0].as_py()]
    for k in range(0, len(seeds), wide):
        own = seeds[k : k + wide]
        column = np.arange(len(own))
        hop[own, column], ways[own, column] = 0, 1.0
        fronts = [np.sort(own)]
        while True:
            front, level = fronts[-1], len(fronts) - 1
            to = out.ahead(front)
            to = to[(hop[to, : len(own)] < 0).any(axis=1)]
            x[front] = np.where(hop[front] == level, ways[front], 0.0)
            got = back.sums(to, x)
            x[front] = 0.0
            new = (got > 0) & (hop[to] < 0)
            some = new.any(axis=1)
            if not some.any():
                break
            to, got, new = to[some], got[some], new[some]
            hop[to] = np.where(new, level + 1, hop[to])
            ways[to] = np.where(new, got, ways[to])
            fronts.append(to)
        for level in range(len(fronts) - 2, 0, -1):
            front, ahead = fronts[level], fronts[level + 1]
            front = front[out.degree[front] > 0]
            x[ahead] = np.where(hop[ahead] == level + 1, (1 + part[ahead]) / np.where(ways[ahead] > 0, ways[ahead], 1.0), 0.0)
            part[front] = np.where(hop[front] == level, ways[front] * out.sums(front, x), part[front])
            x[ahead] = 0.0
        met = np.unique(np.concatenate(fronts))
        score[met] += part[met].sum(axis=1)
        hop[met], ways[met], part[met] = -1, 0.0, 0.0
    some = np.flatnonzero(score)
    return pa.table({"node": pa.array(nodes[some], pa.int64()), "score": pa.array(score[some], pa.float64())})


def _searched(links: DataFrame, seeds: DataFrame, nodes: int) -> DataFrame:
    """(node, score) as ``_shares`` gives it, by joins: levels and shares of a block of seeds go in step, a row for each seed and node."""
    step = by_node(links, "src")
    blocks = max(1, -(-(seeds.count() * nodes) // SEARCHED))
    total = None
    for block in range(blocks):
        own = seeds.filter(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(blocks)) == block)
        fronts = [stored(own.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("ways")))]
        seen = stored(fronts[0].select("seed", "node"))
        while not fronts[-1].isEmpty():
            near = fronts[-1].join(step, fronts[-1]["node"] == step["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
            fronts.append(stored(near.join(seen, ["seed", "node"], "left_anti")))
            old, seen = seen, stored(seen.unionByName(fronts[-1].select("seed", "node")))
            dropped(old)
        share = fronts[-1].select("seed", "node", F.lit(0.0).alias("part"))
        shares = []
        for level in range(len(fronts) - 2, 0, -1):
            # (1 + part) / ways of the next level's nodes goes back along the edges that lead to them
            ahead = fronts[level + 1].join(share, ["seed", "node"], "left").select("seed", F.col("node").alias("next"), ((1 + F.coalesce("part", F.lit(0.0))) / F.col("ways")).alias("each"))
            mine = fronts[level].join(step, fronts[level]["node"] == step["src"]).select("seed", "node", "ways", F.col("dst").alias("next"))
            share = stored(mine.join(ahead, ["seed", "next"]).groupBy("seed", "node").agg(F.sum(F.col("ways") * F.col("each")).alias("part")))
            shares.append(share)
        before = [] if total is None else [total]
        every = [x.select("node", F.col("part").alias("score")) for x in shares] + before
        if every:
            rows = every[0]
            for more in every[1:]:
                rows = rows.unionByName(more)
            total = stored(rows.groupBy("node").agg(F.sum("score").alias("score")))
        dropped(seen, *fronts, *shares, *before)
        del fronts, shares, share, every
        freed(links.sparkSession)
    return links.sparkSession.createDataFrame([], "node long, score double") if total is None else total


def shortest_path(edges: DataFrame, start, goal, most: int = 20) -> DataFrame:
    """One shortest undirected way as (step, node) rows, the least node at every step back; none where there is no way."""
    spark, both = edges.sparkSession, by_node(undirected(edges), "src")
    kind = both.schema["src"].dataType
    front = saved(both.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("hop")))
    seen = front
    for hop in range(1, most + 1):
        if seen.filter(F.col("node") == F.lit(goal)).count() or front.isEmpty():
            break
        near = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        front = saved(near.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = saved(seen.unionByName(front))
    found = seen.filter(F.col("node") == F.lit(goal)).first()
    way = []
    if found:
        way = [(found["hop"], found["node"])]
        while way[-1][0]:
            hop, node = way[-1]
            before = both.filter(F.col("src") == F.lit(node)).join(seen.filter(F.col("hop") == hop - 1), F.col("dst") == F.col("node"))
            way.append((hop - 1, before.agg(F.min("dst")).first()[0]))
    return spark.createDataFrame(way[::-1], f"step int, node {kind.simpleString()}")


def community_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Size, inner edges and density E / (N (N - 1) / 2) of communities (node, community); 0 for one member."""
    a, b = members.withColumnsRenamed({"node": "src"}), members.withColumnsRenamed({"node": "dst", "community": "_other"})
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").filter(F.col("community") == F.col("_other")).groupBy("community").agg(F.count("*").alias("_i"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size")).join(inner, "community", "left").withColumn("inner_edges", F.coalesce("_i", F.lit(0)))
    n = F.col("size")
    return sizes.select("community", "size", "inner_edges", F.when(n > 1, F.col("inner_edges") / (n * (n - 1) / 2)).otherwise(0.0).alias("density"))


def community_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(community, delta) between two snapshots (community, node): new, removed, updated or same.

    Members are compared by count and two independent digests, so no community is gathered.
    """
    def digest(rows, name):
        h = F.xxhash64(F.lit(1), "node"), F.xxhash64(F.lit(2), "node")
        return rows.distinct().groupBy("community").agg(F.struct(F.count("*").alias("n"), F.bit_xor(h[0]).alias("x"), F.sum(h[1].cast("decimal(20,0)")).alias("s")).alias(name))

    rows = digest(after, "a").join(digest(before, "b"), "community", "full_outer")
    delta = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "updated").otherwise("same")
    return rows.select("community", delta.alias("delta"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of communities (node, community) over undirected edges (each once)."""
    both = undirected(edges)
    deg = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")).join(members, "node")
    total = deg.groupBy("community").agg(F.sum("k").alias("k"))
    a, b = members.withColumnsRenamed({"node": "src"}), members.withColumnsRenamed({"node": "dst", "community": "_other"})
    inner = both.join(a, "src").join(b, "dst").filter(F.col("community") == F.col("_other")).groupBy("community").agg(F.count("*").alias("i"))
    every = deg.agg(F.sum("k").alias("m"))  # both directions: twice the edges
    rows = total.join(inner, "community", "left").crossJoin(F.broadcast(every))  # one row
    part = F.coalesce("i", F.lit(0)) / F.col("m") - (F.col("k") / F.col("m")) * (F.col("k") / F.col("m"))
    return rows.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))
