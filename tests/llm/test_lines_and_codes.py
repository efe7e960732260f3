"""Repeated lines, centroids and codebooks against plain versions, DuckDB and their edge cases."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.llm import codebooks, kmeans, line_dedup, oracles
from tessera.llm.common import shared_dir, table

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_centroids", "op13_vector_codes"])
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = __spark_entry__.queries()[name](spark, sf)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    at = [want.columns.index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect())) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


# ---- 11 lines -----------------------------------------------------------------------


def plain_lines(rows, least_chars=40, least_docs=5):
    """(doc_id, lines, dropped, kept text) of each row, in its order."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    low = lambda i: float("-inf") if i is None else i
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(low(i))
    gone = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), low(i)) == low(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def same_lines(docs, rows, **law):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.without_repeated_lines(docs, **law).collect()]
    want = plain_lines(rows, law.get("least_chars", 40), law.get("least_docs", 5))
    assert sorted_rows(got) == sorted_rows(want)


def odd_lines():
    r = random.Random(3)
    common = ["A" * 39, "a" * 40, "Ä" + "b" * 40, "ä" + "b" * 40, "K" + "k" * 40, "K" * 41, "\t x " * 12, "\x0b" + "Z" * 45 + "\x0c", "\xa0" + "z" * 45, "漢" * 40, "😀" * 40, ""]
    rows = []
    for i in range(60):
        lines = [r.choice(common) for _ in range(r.randint(0, 9))] + [f"line {r.random()} of its own, long enough to count"]
        r.shuffle(lines)
        rows.append((i if i % 7 else None, "\n".join(x.upper() if r.random() < 0.2 and x.isascii() else x + " " * r.randint(0, 2) for x in lines)))
    rows += [(61, None), (62, ""), (63, "\n\n"), (64, "\r\n".join(common)), (64, "a" * 40), (64, "a" * 40), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("law", [{}, {"batches": 1}, {"batches": 9, "fanout": 2}, {"least_docs": 1}, {"least_docs": 2, "least_chars": 1}])
def test_lines_like_the_plain_version(spark, law):
    rows = odd_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("t", "a", "b", "pos", "first", "batch", "last", "n", "at"):
        docs = docs.withColumn(name, F.lit("x"))
    same_lines(docs.repartition(3), rows, **law)


def test_lines_of_odd_tables(spark, odd_docs, no_docs):
    same_lines(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()], least_docs=2)
    assert line_dedup.without_repeated_lines(no_docs).count() == 0
    one = "one very common line that every single document of this table holds"
    rows = [(None, one)] * 20 + [(k, one + "\n" + one + f"\nrest {k}") for k in range(2000)] + [(3000, "\n".join(f"a line of a very long text, number {k} of them" for k in range(60_000)))]
    same_lines(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_batches_in_any_order_give_the_same_keys(spark):
    r = random.Random(5)
    rows = [(k, "\n".join(f"{'shared line number of the batches test' * 2} {r.randint(0, 60)}" for _ in range(3))) for k in range(300)]
    lines = line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    want = {(x.a, x.b): x.last for x in line_dedup.keys_of(lines).filter("n >= 5").collect()}
    for order in (range(6), range(5, -1, -1), (3, 0, 5, 1, 4, 2)):
        runs = line_dedup.Runs(spark, 4, fanout=2)
        for k in order:
            runs.add(line_dedup.keys_of(lines.filter(F.col("doc_id") % 6 == k)))
        assert {(x.a, x.b): x.last for x in runs.frequent().collect()} == want
        assert [len(level) for level in runs.levels] == [0, 1, 1]
        folders = [f"{shared_dir(spark).removeprefix('file://')}/{name}" for name in runs.names()]
        assert all(map(os.path.isdir, folders))
        runs.clear()
        assert not any(map(os.path.isdir, folders)) and runs.frequent().count() == 0


def test_settled_keys_are_not_added_again(spark):
    rows = [(k, "a line that all of the documents of this test hold") for k in range(100)]
    lines = line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string"))
    runs = line_dedup.Runs(spark, 4)
    for low in (50, 0):  # the larger ids first
        runs.add(line_dedup.keys_of(lines.filter((F.col("doc_id") >= low) & (F.col("doc_id") < low + 50))))
    assert [spark.table(name).count() for name in runs.names()] == [1, 0]
    runs.clear()


def test_lines_run_without_python(spark, sf):
    frame = line_dedup.op11_line_dedup(spark, sf)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 12 centroids -------------------------------------------------------------------


def lloyd(rows, size, scale, clusters, rounds):
    """{row number: (cluster, distance)} and centroids, by comparing everything in whole numbers."""
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for k in range(rounds + 1):
        found = [near(v) for _, v in rows]
        if k < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(rows, found) if at == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return Counter((i, j, d) for (i, _), (d, j) in zip(rows, found)), centroids


@pytest.mark.parametrize("seed, scale, spread", [(1, 64, 1.0), (2, 1, 1.5), (3, 1, 0.6)])
def test_centroids_with_many_ties(spark, seed, scale, spread):
    r = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in np.round(r.normal(0, spread, 4), 2 if scale > 1 else 0)]) for k in r.integers(0, 300, 400)]
    rows += [(None, [0.0, 1.0, 0.0, 1.0])] * 3 + [(7, [2.0, 2.0, 2.0, 2.0])] * 2
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, centroids = kmeans.clustered(vectors, size=4, scale=scale, clusters=11, rounds=4)
    want, found = lloyd(rows, 4, scale, 11, 4)
    assert centroids.tolist() == found
    assert Counter((x.vec_id, x.cluster, x.distance) for x in got.collect()) == want


def test_bounds_skip_distances(spark):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(0, 8, (12, 16)), 60, axis=0) + r.normal(0, 0.2, (720, 16))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(2)
    rows, _ = kmeans.clustered(vectors, size=16, clusters=12, rounds=5)
    assert rows.agg(F.sum("computed")).first()[0] < 0.3 * 12 * len(x)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(k, [float(k % 5), -0.5, 1e-9, k / 64]) for k in range(9)]
    odd = [(10, None), (11, []), (12, [1.0, 2.0]), (13, [1.0, None, 2.0, 3.0]), (14, [nan, 0.0, 0.0, 0.0]), (15, [0.0, inf, 0.0, 0.0]), (16, [1e300, -1e300, 1e38, 0.0]), (16, [-1e300, 1e300, 0.0, 1.0]), (None, [0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(fine + odd, "vec_id long, embedding array<double>").withColumn("label", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 3))
    for name in ("v", "cluster", "upper", "lower", "distance", "code", "error", "l"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def test_centroids_of_odd_vectors(spark):
    got, centroids = kmeans.clustered(odd_vectors(spark), size=4, clusters=16, rounds=2)
    ids = [r.vec_id for r in got.collect()]
    assert sorted(x for x in ids if x is not None) == [*range(9), 16, 16] and ids.count(None) == 1
    assert len(centroids) == 12 and all(r.distance >= 0 for r in got.collect())
    none = odd_vectors(spark).filter("vec_id = 11")
    rows, centroids = kmeans.clustered(none, size=4)
    assert rows.count() == 0 and len(centroids) == 0


def test_centroid_query_without_rows(spark, tmp_path):
    odd_vectors(spark).filter("false").select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert kmeans.op12_centroids(spark, str(tmp_path)).count() == 0
    assert codebooks.op13_vector_codes(spark, str(tmp_path)).count() == 0


def test_totals_stay_at_the_greatest_long(spark):
    frame = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "d long")
    assert frame.agg(kmeans.total("d")).first()[0] == 2**63 - 1


# ---- 13 codebooks -------------------------------------------------------------------


def plain_codes(rows, scale, parts, entries, rounds):
    """Counter of (vec_id, code, error) and the codebooks, by comparing everything in whole numbers."""
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[p]))
    for k in range(rounds + 1):
        found = [[near(cut(v, p), p) for p in range(parts)] for _, v in rows]
        if k < rounds:
            for p in range(parts):
                for j in range(len(first)):
                    own = [cut(v, p) for (_, v), f in zip(rows, found) if f[p][1] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    return Counter((i, bytes(j for _, j in f).hex(), sum(d for d, _ in f)) for (i, _), f in zip(rows, found)), books


@pytest.mark.parametrize("seed, scale, decimals", [(1, 256, 3), (2, 1, 0), (3, 2, 0)])
def test_codes_with_many_ties(spark, seed, scale, decimals):
    r = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in np.round(r.normal(0, 1.4, 12), decimals)]) for k in r.integers(0, 200, 250)] + [(None, [0.5] * 12)] * 3
    vectors = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(4)
    got, books = codebooks.compressed(vectors, scale=scale, parts=4, entries=9, rounds=3)
    want, found = plain_codes(rows, scale, 4, 9, 3)
    assert books.tolist() == found
    assert Counter((x.vec_id, bytes(x.code).hex(), x.error) for x in got.collect()) == want


def test_code_bounds_skip_distances(spark):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(0, 3, (32, 32)), 20, axis=0) + r.normal(0, 0.02, (640, 32))
    vectors = spark.createDataFrame([(k % 20 * 32 + k // 20, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").coalesce(2)
    rows, _ = codebooks.compressed(vectors, parts=8, entries=32, rounds=3)
    assert rows.agg(F.sum("computed")).first()[0] < 0.3 * 8 * 32 * len(x)


def test_kept_bounds_are_on_the_safe_side():
    d = np.concatenate((np.random.default_rng(1).uniform(0, 3e5, 20_000), [0.0, 1e-12, 65504.0, 65505.0, 1e12]))
    assert (codebooks.kept_above(d).astype(float) >= d).all() and (codebooks.kept_below(d).astype(float) <= d).all()
    assert (kmeans.below(d) <= d).all() and (kmeans.above(d) >= d).all()
    assert (codebooks.kept_below(d).astype(float) >= np.minimum(d, 65504) * 0.999 - 1e-7).all()


def test_codes_of_odd_vectors(spark, tmp_path):
    odd_vectors(spark).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = codebooks.op13_vector_codes(spark, str(tmp_path)).collect()
    ids = [r.vec_id for r in rows]
    assert sorted(x for x in ids if x is not None) == [*range(9), 11, 12, 16, 16] and ids.count(None) == 1
    sums = defaultdict(int)
    labels = {r.vec_id: r.label for r in table(spark, str(tmp_path), "embeddings").select("vec_id", "label").collect()}
    for r in rows:
        sums[labels[r.vec_id]] += r.error
    assert all(r.label_error == sums[labels[r.vec_id]] and len(r.code) == 32 for r in rows)


def test_oracles_take_the_floor_for_either_sign():
    for s, n in ((-7, 2), (7, 2), (-8, 2), (-1, 3), (0, 3)):
        assert duckdb.sql(f"SELECT {oracles._MEAN} FROM (SELECT {s}::HUGEINT AS s, {n}::BIGINT AS n)").fetchall()[0][0] == s // n
