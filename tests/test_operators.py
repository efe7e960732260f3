"""Literal cases, folds against loops, and edge cases of the operators."""

import math

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors
from tessera.operators import analytics, evaluation, filters, governance, graph, memory, quality, retrieval, temporal
from tessera.streaming import operators as st

import pytest


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_fusion_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, "d1", 1), (1, "d2", 2)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "d2", 1), (1, "d3", 2)], "qid int, id string, rank int")
    got = {r.id: r.score for r in retrieval.fuse([a, b]).collect()}
    assert got == {"d1": round(1 / 61, 9), "d2": round(1 / 62 + 1 / 61, 9), "d3": round(1 / 62, 9)}
    empty = b.filter("false")
    assert {r.id for r in retrieval.fuse([a, empty]).collect()} == {"d1", "d2"}


def test_bm25_prefers_rare_terms_and_drops_empty_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, ""), (4, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "beta alpha")], "qid int, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, queries).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    common = math.log(1 + 0.5 / 2.5)
    assert got[1] == pytest.approx(idf * 2.5 / 2.5 + common, abs=1e-6)


def test_cosine_of_zero_vector_is_zero(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert one(rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"))).c == 0.0


def test_fused_dedup_is_sequential(spark):
    rows = spark.createDataFrame([(1, "u", "t"), (2, "u", "x"), (3, "v", "x"), (4, "", ""), (5, "", "")], "seq int, url string, text string")
    assert sorted(r.seq for r in retrieval.dedup_fused(rows).collect()) == [1, 4, 5]


def test_metadata_filter(spark):
    with pytest.raises(ValueError):
        filters.MetadataFilter(created_after="2024-02-01", created_before="2024-01-01")
    with pytest.raises(ValueError):
        filters.MetadataFilter(source_in=("a",), source_not_in=("a",))
    rows = spark.createDataFrame([("a", ["x", "y"]), (None, ["x"]), ("b", ["x", "y"])], "source string, tags array<string>")
    wanted = filters.MetadataFilter(source_not_in=("b",), tags=("x",))
    assert rows.filter(wanted.column()).count() == 2
    with pytest.raises(ValueError):
        filters.scoped(rows, ["a"])


def test_intervals_are_half_open(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01' AS valid_from, timestamp'2024-01-02' AS valid_to")
    assert rows.filter(temporal.at(temporal.instant("2024-01-01"))).count() == 1
    assert rows.filter(temporal.at(temporal.instant("2024-01-02"))).count() == 0
    assert rows.filter(temporal.overlaps(temporal.instant("2024-01-02"), temporal.instant("2024-01-03"))).count() == 1


def test_asof_join_takes_the_last_row_before(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("m", 9, 3)], "key string, ts int, id int")
    right = spark.createDataFrame([("k", 2, 10.0), ("k", 5, 20.0), ("k", 5, 15.0)], "key string, ts int, v double")
    got = {r.id: r.v for r in temporal.asof_join(left, right, "key", "ts", "v").collect()}
    assert got == {1: 20.0, 2: None, 3: None}


def test_exclusive_quantiles_like_the_standard_library(spark):
    import statistics

    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.3]
    rows = spark.createDataFrame([(sorted(values),)], "s array<double>")
    got = one(rows.select(*[analytics.exclusive_quantile(F.col("s"), q).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]))
    assert list(got) == pytest.approx(statistics.quantiles(values, n=4, method="exclusive"))
    single = spark.createDataFrame([([7.0],)], "s array<double>")
    assert one(single.select(analytics.exclusive_quantile(F.col("s"), 0.95).alias("v"))).v == 7.0


def test_decay_and_missing_values(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = spark.sql("SELECT timestamp'2024-01-02' AS ts, CAST(NULL AS double) AS imp UNION ALL SELECT CAST(NULL AS timestamp), 0.1")
    got = rows.select(memory.should_forget(F.col("imp"), F.col("ts"), now).alias("f")).collect()
    assert [r.f for r in got] == [False, False]
    assert one(spark.range(1).select(memory.half_life(F.lit(30.0), 30).alias("d"))).d == 0.5


def test_triangle_graph(spark):
    edges = spark.createDataFrame([("e1", "e2"), ("e2", "e3"), ("e1", "e3"), ("x", "y")], "src string, dst string")
    assert one(graph.statistics(edges.limit(3))).density == 1.0
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"e1": "e1", "e2": "e1", "e3": "e1", "x": "x", "y": "x"}
    assert sum(r["rank"] for r in graph.pagerank(edges, rounds=8).collect()) == pytest.approx(1.0)
    seeds = spark.createDataFrame([("e1",)], "node string")
    assert {(r.node, r.hop) for r in graph.k_hop(edges, seeds, 2).collect()} == {("e1", 0), ("e2", 1), ("e3", 1)}
    assert graph.components(edges.filter("false")).count() == 0


def test_label_propagation_like_a_loop(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    labels = {n: n for n in near}
    for _ in range(5):
        count = lambda n: {x: sum(labels[m] == x for m in near[n]) for x in {labels[m] for m in near[n]}}
        labels = {n: min((-c, x) for x, c in count(n).items())[1] for n in near}
    got = graph.label_propagation(spark.createDataFrame(pairs, "src int, dst int")).collect()
    assert {r.node: r.community for r in got} == labels


def test_hygiene_of_relations(spark):
    rows = spark.createDataFrame([("A", "a", "KNOWS", "s"), ("A", "B", "KNOWS", None), ("A", "B", "ODD", "s"), ("B", "C", "KNOWS", "s")], "source string, target string, type string, evidence string")
    got = one(quality.hygiene(rows, ("KNOWS",)))
    assert (got.loops, got.no_evidence, got.bad_type, got.score) == (1, 1, 1, 25.0)
    assert one(quality.hygiene(rows.filter("false"), ("KNOWS",))).score == 100.0


def test_luhn_and_redaction(spark):
    rows = spark.createDataFrame([("pay 4111 1111 1111 1111 to a.b@mail.com", "4111111111111111"), ("4111 1111 1111 1112", "4111111111111112")], "t string, d string")
    assert [r.v for r in rows.select(tx.luhn_valid(F.col("d")).alias("v")).collect()] == [True, False]
    assert rows.select(governance.redacted(F.col("t")).alias("r")).first().r == "pay [CARD] to [EMAIL]"
    assert [len(r.c) for r in rows.select(governance.detected(F.col("t"), "card").alias("c")).collect()] == [1, 0]


def test_ndcg_of_perfect_and_irrelevant_rankings(spark):
    rows = spark.createDataFrame([("q", 1.0, 0.9, 1), ("q", 0.0, 0.1, 2), ("z", 0.0, 0.5, 3)], "g string, rel double, s double, id int")
    assert {r.g: r.ndcg for r in evaluation.ndcg(rows, ["g"], "rel", "s", "id", 5).collect()} == {"q": 1.0, "z": 0.0}
    assert len(evaluation.weight_grid(0.05)) == 231 and all(abs(sum(w) - 1) < 1e-9 for w in evaluation.weight_grid(0.05))


def test_greedy_matching_like_a_loop(spark):
    rows = [("d", 1, 1, 0.9), ("d", 1, 2, 0.8), ("d", 2, 1, 0.9), ("d", 2, 2, 0.2), ("d", 3, 2, 0.7)]
    pairs = spark.createDataFrame(rows, "g string, p int, q int, s double")
    assert sorted((r.p, r.q) for r in evaluation.greedy_match(pairs, "g", "p", "q", "s", 0.5).collect()) == [(1, 1), (3, 2)]


def test_rate_limit_counts_accepted_calls_only():
    assert st.accepted_calls([0, 1, 2, 61.5, 62.5], 2)[0] == [True, True, False, True, True]


@pytest.mark.parametrize("name,kind", [("A thing", "PERSON"), ("x", "PERSON"), ("May 2", "DATE"), ("seven", "CARDINAL"), ("the", "ORG")])
def test_entity_reasons(spark, name, kind):
    want = {"A thing": None, "x": "too_short", "May 2": "short_for_type", "seven": "noise_type", "the": "stop_name"}[name]
    rows = spark.createDataFrame([(name, kind)], "n string, k string")
    assert one(rows.select(quality.entity_reason(F.col("n"), F.col("k"), ("the",)).alias("r"))).r == want


def test_chain_is_checked_and_serialised(spark):
    from tessera.plans.chain import Chain

    chain = Chain().step("a", "filter", condition="id > 3").step("b", "top", by="id", k=2)
    assert [r.id for r in Chain.from_json(chain.to_json()).apply(spark.range(10)).collect()] == [9, 8]
    with pytest.raises(ValueError):
        chain.step("a", "count", keys=[])
    with pytest.raises(ValueError):
        chain.step("c", "drop_table")
    with pytest.raises(ValueError):
        Chain().apply(spark.range(1))


def test_section_chunks_like_a_loop(spark):
    from tessera.operators.entities import section_chunks

    sizes = [300, 1500, 900, 800, 200, 1800, 10]
    rows = [("d", k, f"h{k}", f"t{k}", n) for k, n in enumerate(sizes)]
    got = section_chunks(spark.createDataFrame(rows, "doc_id string, seq int, heading string, text string, tokens long")).orderBy("chunk_no").collect()
    assert [r.headings for r in got] == [["h0"], ["h1"], ["h2", "h3"], ["h4"], ["h5"], ["h6"]]


def test_entities_are_resolved_by_edits_and_containment(spark):
    from tessera.operators.entities import same_entities

    rows = [(1, "Kubernetes", "T"), (2, "kubernetes ", "T"), (3, "Kubernetis", "T"), (4, "Kubernetes Cluster", "T"), (5, "Docker", "T"), (6, "Kubernetes", "X")]
    got = {r.id: r.canonical for r in same_entities(spark.createDataFrame(rows, "id int, name string, kind string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_event_log_and_line_check(spark, tmp_path):
    from tessera.sources import readers

    path = tmp_path / "log.jsonl"
    path.write_text('{"timestamp":"2024-01-01T00:00:00Z","stage":"a","latency_ms":1.5}\nnot json\n{"timestamp":"2024-01-03T00:00:00Z","stage":"b"}\n')
    assert readers.read_events(spark, str(path)).filter("stage is not null").count() == 2
    assert readers.read_events(spark, str(path), stop="2024-01-02").count() == 1
    got = one(readers.verify_lines(spark, str(path), ("timestamp", "latency_ms")))
    assert (got.valid, got.invalid) == (1, 2)


def test_benchmark_sets_are_normalised(spark):
    from tessera.sources import readers

    marco = spark.sql("SELECT 1 AS id, 'q' AS query, array('a') AS answers, array(named_struct('text', 'x', 'is_selected', 0), named_struct('text', 'y', 'is_selected', 1)) AS passages UNION ALL SELECT 2, 'q', array(), array(named_struct('text', 'x', 'is_selected', 0))".replace("array()", "cast(array() as array<string>)"))
    assert [(r.question_id, r.contexts) for r in readers.marco(marco.filter("id = 1")).collect()] == [("marco_1", ["y"])]
    hotpot = spark.sql("SELECT 1 AS id, 'q' AS question, 'a' AS answer, array(named_struct('title', 't', 'sentences', array('s0', 's1'))) AS paragraphs, array(named_struct('title', 't', 'sentence', 1)) AS facts")
    assert readers.hotpot(hotpot).first().contexts == ["s1"]
    fever = spark.createDataFrame([(1, "c", "SUPPORTS"), (2, "", "X")], "id int, claim string, label string")
    assert readers.fever(fever).count() == 1
