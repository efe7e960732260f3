"""Graph measures, entity resolution, ranks, folds, readers and the ingesting stream against plain versions."""

import io
import itertools
import random
import zipfile
from collections import deque

from pyspark.sql import functions as F

from tessera.operators import analytics, entities, graph, knowledge, retrieval
from tessera.sources import readers, sections
from tessera.streaming import ingest


def edges_of(seed, n=9, m=16):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def plain_betweenness(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    score = dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        ways, queue, found = [[s]], deque([[s]]), []
        while queue:
            way = queue.popleft()
            if found and len(way) > len(found[0]):
                break
            if way[-1] == t:
                found.append(way)
                continue
            queue += [[*way, x] for x in near[way[-1]] if x not in way]
        for way in found:
            for x in way[1:-1]:
                score[x] += 1 / len(found)
        assert ways
    return score


def test_betweenness_and_closeness_like_plain_searches(spark):
    edges = edges_of(3)
    both = spark.createDataFrame([*edges, *((b, a) for a, b in edges)], "src int, dst int")
    nodes = both.select(F.col("src").alias("node")).distinct()
    want = plain_betweenness(edges)
    got = {r.node: r.score for r in graph.betweenness(both, nodes).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    hops = {}
    for r in graph.levels(both, nodes).collect():
        hops.setdefault(r.seed, []).append(r.hop)
    near = {r.node: r.closeness for r in graph.closeness(both, nodes).collect()}
    for x, own in hops.items():
        reach = len(own) - 1
        assert abs(near[x] - reach / sum(own) * reach / (len(want) - 1)) < 1e-9


def test_shortest_path_ends(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (7, 8)], "src int, dst int")
    assert [r.node for r in graph.shortest_path(rows, 1, 4).orderBy("step").collect()] == [1, 5, 4]
    assert graph.shortest_path(rows, 1, 8).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_entity_pairs_are_complete(spark):
    """Every pair within two edits or contained is a candidate, wherever the names differ."""
    r = random.Random(12)
    base = ["".join(r.choice("abcd") for _ in range(r.randint(4, 14))) for _ in range(60)]
    names = set(base)
    for name in base:
        for _ in range(3):
            at = r.randrange(len(name))
            names.add(r.choice((name[:at] + name[at + 1 :], name[:at] + "x" + name[at:], "zz" + name, name[2:], name + "_tail")))
    names = sorted(n.strip("_") for n in names if n.strip("_"))
    exact = spark.createDataFrame([("k", n, i) for i, n in enumerate(sorted(set(names)))], "kind string, key string, rep int")
    keys = {x.rep: x.key for x in exact.collect()}
    near = {frozenset((x.rep, x.rep2)) for x in entities._near_names(exact, 2, 5).collect()}
    inside = {(x.rep, x.rep2) for x in entities._inside_names(exact, 6).collect()}
    for i, j in itertools.combinations(keys, 2):
        a, b = keys[i], keys[j]
        assert (frozenset((i, j)) in near) == (min(len(a), len(b)) >= 5 and plain_edits(a, b) <= 2), (a, b)
        for p, q in ((i, j), (j, i)):
            assert ((p, q) in inside) == (len(keys[q]) >= 6 and keys[q] in keys[p])


def test_near_embeddings_join_names(spark):
    rows = [(1, "alpha", "T", [1.0, 0.0]), (2, "omega", "T", [0.99, 0.05]), (3, "omega", "X", [1.0, 0.0])]
    got = {r.id: r.canonical for r in entities.same_entities(spark.createDataFrame(rows, "id int, name string, kind string, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_ranks_span_partitions(spark):
    rows = [("a" if k % 3 else "b", (k * 37) % 101) for k in range(300)]
    got = analytics.ranks(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()
    for g in "ab":
        own = sorted((x._r, x.v) for x in got if x.g == g)
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for h, v in rows if h == g)


def test_rebalance_like_a_loop(spark):
    rows = [("m", "a", 1000, 100), ("m", "b", 2000, 1900), ("m", "c", 500, 480), ("m", "d", 1000, 500)]
    got = {r.skill: r.allocated for r in analytics.rebalance(spark.createDataFrame(rows, "m string, skill string, allocated long, used long"), "m", "skill", 6000).collect()}
    assert got == {"a": 700, "b": 2000 + 900, "c": 500 + 450, "d": 1000}


def test_index_is_read_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, ""), (4, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "beta alpha"), (8, "nothing")], "qid int, text string")
    retrieval.write_index(docs, str(tmp_path / "i"))
    rows = lambda df: sorted((r.qid, r.id, r.score, r.rank) for r in df.collect())
    assert rows(retrieval.search_index(spark, str(tmp_path / "i"), queries, 5)) == rows(retrieval.bm25_top(docs, queries, 5))


def test_blocks_of_queries_give_the_same_rows(spark, monkeypatch):
    points = spark.createDataFrame([(k, [float(k % 5), float(k % 7), 1.0]) for k in range(60)], "id long, embedding array<double>")
    ask = points.select(F.col("id").alias("qid"), F.col("embedding").alias("q_embedding"))
    rows = lambda df: sorted((r.qid, r.id, r.score, r.rank) for r in df.collect())
    assert rows(retrieval.knn_top(points, ask, 4)) == rows(retrieval.knn_top(points, ask, 4, rows=7))


def test_pronouns_take_the_name_before(spark):
    texts = ["Ada wrote notes. She kept them.", "it rains", "Max Planck met a friend and he smiled."]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").orderBy("k").select(knowledge.resolved(F.col("s")).alias("t")).collect()]
    assert got == ["Ada wrote notes. Ada kept them.", "it rains", "Max Planck met a friend and Max Planck smiled."]


def test_docx_paragraphs(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as file:
        file.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = sections.docx_paragraphs(readers.scan_files(spark, str(tmp_path), "*.docx")).orderBy("seq").collect()
    assert [(r.text, r.style) for r in rows] == [("Top", "Heading 2"), ("a b", "")]


def test_weights_and_lines_round_trip(spark, tmp_path):
    readers.write_weights(spark, {"keyword": {"a": 0.5}}, str(tmp_path / "w"))
    assert readers.read_weights(spark, str(tmp_path / "w")).first().weights == {"a": 0.5}
    pairs = spark.createDataFrame([("q", "i", "d", 0.1, 0.2, 0.3, None)], readers.PAIR)
    readers.write_lines(pairs, str(tmp_path / "p"))
    assert readers.read_lines(spark, str(tmp_path / "p"), readers.PAIR).collect() == pairs.collect()


def test_a_failing_chunk_stops_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 25), (2, "bad"), (3, ""), (4, None), (5, "fine")], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))

    def embed(text):
        if text == "bad":
            raise ValueError("no vector")
        return [float(len(text))]

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, embed, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c"), 10).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "good")).select("doc_id", "chunk_no", "embedding").orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, r.embedding) for r in good] == [(1, 0, [10.0]), (1, 1, [10.0]), (1, 2, [5.0]), (5, 0, [4.0])]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [(r.doc_id, r.error, r.tried) for r in bad] == [(2, "no vector", 3)]


def test_docx_sections(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ""
    paragraph = lambda t, s="": f"<w:p>{style(s)}<w:r><w:t>{t}</w:t></w:r></w:p>"
    texts = [("before",), ("One", "Heading1"), ("a",), ("b",), ("  ",), ("Inner", "Heading3"), ("Last", "Title"), ("c", "Quote")]
    for name, body in (("a", "".join(paragraph(*t) for t in texts)), ("c", "")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as file:
            file.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        (tmp_path / f"{name}.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = sections.docx_sections(readers.scan_files(spark, str(tmp_path), "*.docx")).orderBy("section_no").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "Document", 1, "before", 1), (1, "One", 1, "a\nb", 2), (2, "Inner", 3, "", 0), (3, "Last", 1, "c", 1)]


def test_dealt_tables_are_not_shuffled_again(spark):
    rows = spark.range(1000).select((F.col("id") % 97).alias("src"), F.col("id").alias("dst"))
    ways = graph.by_node(rows, "src")
    sums = rows.groupBy("src").agg(F.sum("dst").alias("s"))
    plan = ways.join(sums.hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the sums
    assert sorted(map(tuple, ways.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_hot_nodes_are_left_to_adaptive_joins(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 100)
    monkeypatch.setattr(graph, "HOT", 2)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("src"), F.col("id").alias("dst"))
    ways = graph.by_node(rows, "src")
    plan = ways.join(rows.groupBy("src").count().hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and ways.count() == 1000
