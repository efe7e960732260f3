"""Plans whose work or memory would grow faster than their rows, and the results of what replaced them."""

import random
import re

from tessera.operators import entities, retrieval, sectiongraph
from tessera.plans import metrics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_read_no_frame_to_the_end(spark):
    """such a frame is summed anew for each row."""
    rows = [("c", i, f"f{i % 7}", "d", i % 3, (i % 10) / 10) for i in range(300)]
    got = entities.canonical_records(spark.createDataFrame(rows, "canonical string, place long, form string, description string, chunk int, confidence double"))
    seen, conf = set(), 0.0
    for _, _, form, _, _, x in rows:
        seen.add(form)
        conf = (conf * (len(seen) - 1) + x) / len(seen) if len(seen) > 1 else x
    assert abs(got.first()["confidence"] - conf) < 1e-9
    assert ", 1, unboundedfollowing" not in plan(got).lower()


def test_no_sketch_for_each_user(spark, tmp_path):
    """a sketch is kept for each type, not for each type and user."""
    rows = [(i, f"t{i % 2}", None if i % 5 == 0 else i % 40) for i in range(400)] + [(400, None, 1), (401, "none", None)]
    spark.createDataFrame([(*x, "{}") for x in rows], "event_id long, event_type string, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = metrics.approx_distinct(spark, str(tmp_path))
    want = {t: len({u for _, e, u in rows if e == t and u is not None}) for t in ("t0", "t1", None, "none")}
    assert {r.event_type: (r.users, r.near) for r in got.collect()} == {t: (n, True) for t, n in want.items()}
    for keys in re.findall(r"keys=\[([^\]]*)\], functions=\[[^\]]*approx_count_distinct", plan(got)):
        assert "user_id" not in keys


def test_sections_are_folded_in_batches(spark):
    """a task passes many documents and may meet a document in several batches."""
    r = random.Random(3)
    rows = [(None if d == 0 else d, k, f"h{k}", f"t{d}.{k}", r.choice([0, 10, 300, 700, 1500])) for d in range(60) for k in range(r.randint(1, 40))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = entities.section_chunks(spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, seq int, heading string, text string, tokens long"))
        got = sorted(((x.doc_id or 0), x.chunk_no, x.text, tuple(x.headings), x.tokens) for x in df.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for d in range(60):
        chunks, open_ = [], []
        for row in (x for x in rows if (x[0] or 0) == d):
            if open_ and (row[4] > 1200 or sum(x[4] for x in open_) + row[4] > 1800):
                chunks.append(open_)
                open_ = []
            if row[4] > 1200:
                chunks.append([row])
            else:
                open_.append(row)
        chunks += [open_] if open_ else []
        want += [(d, k, "\n".join(x[3] for x in c), tuple(x[2] for x in c), sum(x[4] for x in c)) for k, c in enumerate(chunks)]
    assert got == sorted(want) and "FlatMapGroupsInPandas" not in plan(df)


def test_terms_are_met_by_their_inner_word(spark):
    """a text is lowered once and not searched for each term."""
    texts = [(1, "Adoja DEL yx"), (2, "xadoja del y"), (3, "adoja  del y"), (4, "a  b"), (5, None), (6, ""), (7, "DEL"), (8, "one del\ny"), (9, "ÄB del Öl und")]
    terms = [(1, "adoja del y"), (2, "adoja del y"), (3, "a  b"), (4, "del"), (5, ""), (6, None), (7, "ja del"), (8, "äb del öl"), (9, "no such words")]
    df = retrieval.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "item int, term string"), "text", "term")
    want = {(i, k) for i, t in texts for k, w in terms if t is not None and w is not None and w in t.lower()}
    got = [(r.id, r["item"]) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "map_keys" in plan(df)
    none = retrieval.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms[3:4], "item int, term string"), "text", "term")
    assert {r.id for r in none.collect()} == {i for i, k in want if k == 4}
    assert retrieval.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "item int, term string"), "text", "term").count() == 0


def test_only_phrases_that_are_named_are_shuffled(spark):
    """a section's own phrases go on only where a heading of its document names them."""
    rows = [(k, "x", k, 1, "alpha section" if k == 0 else "it", "see alpha section of the long text") for k in range(5)] + [(9, "y", 0, 1, "other thing", "alpha section other")]
    df = sectiongraph.references(spark.createDataFrame(rows, "id long, doc string, seq int, level int, heading string, text string"))
    assert {(r.src, r.dst) for r in df.collect()} == {(k, 0) for k in range(1, 5)}
    assert "explode(array_intersect" in plan(df)


def test_a_matrix_of_scores_is_bounded(spark, monkeypatch):
    """a task holds few scores at once, whatever the number of queries and points."""
    real = retrieval.best_of

    def checked(ids, qids, score, fits, k):
        assert score.size <= 40
        yield from real(ids, qids, score, fits, k)

    monkeypatch.setattr(retrieval, "SCORES", 40)
    monkeypatch.setattr(retrieval, "best_of", checked)
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], r.choice(["a", "b", "c"])) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>, scope string")
    queries = points.filter("id % 7 = 0").withColumnsRenamed({"id": "qid", "embedding": "q_embedding"})
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    want = {i: [k for _, k in sorted((-cosine(v, w), k) for k, w, t in rows if t == s and k != i)][:3] for i, v, s in rows if i % 7 == 0}
    got = {}
    for x in retrieval.knn_top(points, queries, 3, scoped=True).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append(x.id)
    assert got == want
