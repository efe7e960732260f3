"""Models and searches against plain versions, extreme values, whole groups, and stages on odd tables."""

import itertools
import math
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, language_id, pii, sharding, toxicity


# ---- language ----


def test_paths_like_trying_all(spark):
    """The labels' path has the value of the best of all label sequences, switches paid."""
    r = np.random.default_rng(4)
    for _ in range(40):
        n, m = int(r.integers(1, 7)), int(r.integers(2, 4))
        scores = r.normal(0, 8, (n, m))
        value = lambda path: sum(scores[k, x] for k, x in enumerate(path)) - language_id.PENALTY * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(m), repeat=n)))
        found = language_id.viterbi(scores, np.array([0, n]), np.array([0]))[0]
        assert value(list(found)) == pytest.approx(best)


def test_letters_not_bytes_are_weighed():
    flags = lambda s: language_id.letter_bytes(np.frombuffer(s.encode(), np.uint8))
    assert flags("añ — 漢字😀×é").tolist() == [True] * 3 + [False] * 5 + [True] * 6 + [False] * 6 + [True] * 2
    word = np.frombuffer("xпривет".encode(), np.uint8)
    script = language_id.word_scripts(word, np.array([0]), np.array([len(word)]))
    assert language_id.SCRIPTS[script[0]] == "cyrillic"


def test_rare_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_ROWS", 50)
    rows = [(k, "the cat and the dog went home", "en") for k in range(3000)] + [(5000 + k, "zwölf boxkämpfer jagen viktor", "de") for k in range(6)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    langs, _, _ = language_id.predict(model, pa.array(["boxkämpfer jagen", "the dog went home", "—😀", None]))
    assert langs == ["de", "en", "und", "und"]


# ---- sharding ----


def test_groups_that_fit_a_shard_stay_whole(spark):
    rows = [(k, f"group {k % 9} " * (20 + k % 9)) for k in range(900)] + [(10_000 + k, f"own text {k} " * 5) for k in range(3000)] + [(20_000 + k, "hot " * 30) for k in range(2000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    text_of, shards_of, size = dict(rows), defaultdict(set), defaultdict(int)
    for x in got:
        shards_of[text_of[x.doc_id]].add(x.shard)
        size[text_of[x.doc_id]] += x.size
    share = sum(size.values()) / 6
    rows_share = len(rows) / 6
    for text, found in shards_of.items():
        n = sum(t == text for _, t in rows)
        if size[text] < share / 2 and n < rows_share / 2:
            assert len(found) == 1
    load = np.array([[sum(x.size for x in got if x.shard == s), sum(x.shard == s for x in got)] for s in range(6)], float)
    assert (load[:, 0].max() - load[:, 0].min()) <= 0.01 * load[:, 0].mean()
    assert (load[:, 1].max() - load[:, 1].min()) <= 0.25 * load[:, 1].mean()


def test_all_three_measures_are_near_equal(spark):
    r = np.random.default_rng(2)
    sizes = np.stack([r.lognormal(8, 1, 4000).round(), r.lognormal(6, 1, 4000).round(), r.integers(1, 30, 4000)], axis=1).astype(float)
    load = np.stack([np.bincount(sharding.place(sizes, 40), sizes[:, d], 40) for d in range(3)], axis=1)
    spread = (load.max(axis=0) - load.min(axis=0)) / load.mean(axis=0)
    assert spread[0] <= 1e-4 and spread[1] <= 0.05 and spread[2] <= 0.05, spread


def test_few_groups_like_trying_all():
    r = np.random.default_rng(8)
    for _ in range(10):
        sizes = np.stack([r.integers(50, 100, 8)] * 3, axis=1).astype(float)
        spread = lambda shard: np.ptp(np.bincount(shard, sizes[:, 0], 3))  # noqa: B023, E731
        best = min(spread(np.array(s)) for s in itertools.product(range(3), repeat=8))
        assert spread(sharding.place(sizes, 3)) <= best + sizes[:, 0].max() / 2


# ---- toxicity ----


def test_posteriors_like_bayes():
    """Independent voters: the posterior is Bayes' rule, the quiet rows' odds apart."""
    a, b, prior = np.array([0.6, 0.3]), np.array([0.1, 0.05]), 0.2
    votes = np.array([[1, 0], [0, 1], [1, 1.0]])
    got = toxicity.posterior(votes, a, b, np.zeros((2, 2)), prior, np.full(3, -1), 0.0)
    for row, p in zip(votes, got):
        odds = prior / (1 - prior) * np.prod(np.where(row == 1, a / b, 1))
        assert p == pytest.approx(odds / (1 + odds))


def test_distributed_regression_like_a_plain_one(spark):
    r = np.random.default_rng(3)
    votes = (r.random((400, 5)) < 0.3).astype(float)
    truth = 1 / (1 + np.exp(-(votes @ np.array([2.0, -1, 0.5, 0, 1]) - 1)))
    sets = [tuple(map(int, np.flatnonzero(v))) for v in votes]
    goal = {s: float(t) for s, t in zip(sets, truth)}
    rows = spark.createDataFrame([(list(s), -1, float(sets.count(s))) for s in sorted(set(sets))], "got array<int>, label int, weight double")
    target = lambda v, known: np.array([goal[tuple(map(int, np.flatnonzero(x)))] for x in v])
    w, c = toxicity.fit_linear(rows, 5, target)
    x, plain, penalty = np.column_stack((votes, np.ones(400))), np.zeros(6), np.array([0.1] * 5 + [1e-6])
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(x @ plain)))
        plain -= 0.01 * (x.T @ (p - truth) + penalty * plain)
    assert np.allclose([*w, c], plain, atol=1e-3)


def test_words_of_any_length_vote(spark):
    long = "x" * 500
    rows = [(k, f"{long} walks {k}" if k % 4 == 0 else f"a quiet street {k}") for k in range(400)]
    labels = [(k, int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.patterns_of(rows[0][1])
    assert toxicity.long_name(long) in found and long[:6] in found
    model = toxicity.Model([toxicity.long_name(long), "walks "])
    assert toxicity.fired(f"so {long}", model.automaton()) == [0] and toxicity.fired(f"so {long}y walks", model.automaton()) == [1]
    got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    again = toxicity.scored(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(2)).collect()
    assert {x.doc_id: round(x.score, 6) for x in got} == {x.doc_id: round(x.score, 6) for x in again}


# ---- vectors ----


def test_finite_vectors_of_any_magnitude(spark):
    rows = [(0, [1e-200] * 4, 1), (1, [1e200] * 4, 1), (2, [2e200] * 4, 1), (3, [5e-324] * 4, 1), (4, [1.0] * 4, 1), (5, [1.0, -1.0, 1.0, -1.0], 1), (6, [0.0] * 4, 1), (7, [float("inf")] * 4, 1), (8, None, 1), (9, [1.0] * 4, None), (10, [3.0] * 3, 1), (11, [3.0] * 3, 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[k] == (4, 0, k == 0) for k in range(5))
    assert all(got[k] == (0, k, True) for k in range(5, 10)) and got[10] == (1, 10, True) and got[11] == (1, 10, False)


def test_recall_on_clusters_at_the_threshold(spark):
    """Clustered vectors with pairs just over 0.93: nine in ten links and more are found."""
    r = np.random.default_rng(6)
    centres = embedding_dedup.unit(r.standard_normal((30, 64)))
    base = embedding_dedup.unit(centres[r.integers(0, 30, 1500)] + 0.12 * r.standard_normal((1500, 64)))
    side = r.standard_normal(base.shape)
    side = embedding_dedup.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    near = 0.935 * base + math.sqrt(1 - 0.935**2) * side
    x = np.concatenate((base, near))
    rows = [(k, [float(c) for c in v], k % 2) for k, v in zip(range(3000), x[np.argsort(np.tile(np.arange(1500), 2), kind="stable")])]
    rows = [(k, v, k // 2 % 3) for k, v, _ in rows]
    v = embedding_dedup.unit(np.array([v for _, v, _ in rows]))
    label = np.array([y for _, _, y in rows])
    cos = (v @ v.T >= embedding_dedup.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(cos, False)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    found = sum(x.n_links for x in got)
    assert 0.9 * cos.sum() <= found <= cos.sum() + 2, (found, cos.sum())


# ---- personal data ----


def test_field_like_trying_all_segmentations():
    model = pii.field()
    for text in ("call (555) 123-4567 or 555-123-4567", "mail a.b@c.org 12", "x 10.0.0.1 y", "4111 1111-1111 1111"):
        for tokens in pii.regions(text):
            tokens = list(tokens)
            options = [(i, j, max(model.score(k, f) for k in range(4))) for i, j, _, _, f in pii.candidates(text, tokens)]
            options = [o for o in options if o[2] > 0]

            def best(at, options=options):
                return max([0.0, *(s + best(j) for i, j, s in options if i >= at)])

            found = model.best(text, tokens)
            place = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
            scores = {(i, j): s for i, j, s in options}
            assert sum(scores[place[0][a], place[1][b]] for a, _, b in found) == pytest.approx(best(0))


# ---- stages ----


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs, name):
    """Rows without text or id pass through the filters; texts are left alone where nothing is found."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_docs, sf)
    assert stage(spark, no_docs, sf).count() == 0
    if name == "packing":
        assert out.select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()
        return
    assert out.columns == odd_docs.columns
    kept, before = {r.doc_id for r in out.collect()}, {r.doc_id for r in odd_docs.collect()}
    gone = before - kept
    assert gone == ({5} if name == "near_dedup" else set()) or (name == "near_dedup" and gone <= {5, 6})
    if name == "pii":
        texts = lambda rows: sorted(str(r.text) for r in rows.select("text").collect())
        assert texts(out.filter(F.col("doc_id") != 7)) == texts(odd_docs.filter(F.col("doc_id") != 7))


def test_rows_without_an_id_are_held_out(odd_docs):
    got = language_id.identified(odd_docs).filter("doc_id IS NULL").collect()
    assert [x.held_out for x in got] == [True]
