"""Evaluation queries: labels are relevance judgements, document length and source the features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.plans.registry import query
from tessera.sources.tables import load

_J = "j AS (SELECT l.doc_id, d.source, d.lang, l.quality::DOUBLE AS rel, least(d.n_chars / 5000.0::DOUBLE, 1.0) AS a, (d.doc_id % 97) / 97.0::DOUBLE AS b, (d.doc_id % 31) / 31.0::DOUBLE AS c FROM labels l JOIN documents d USING (doc_id))"


def judged(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "lang", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("a"))
    rows = load(spark, d, "labels").join(docs, "doc_id").withColumn("rel", F.col("quality").cast("double"))
    return rows.withColumn("b", F.col("doc_id") % 97 / 97.0).withColumn("c", F.col("doc_id") % 31 / 31.0)


_NDCG = """SELECT {0}, round(CASE WHEN sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN p <= 5 THEN rel / log2(p + 1) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) ELSE 0 END) ELSE 0 END, 6) AS ndcg FROM {1} GROUP BY {0}"""


@query(f"WITH {_J}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY a DESC, doc_id) AS p, row_number() OVER (PARTITION BY source ORDER BY rel DESC, doc_id) AS i FROM j) " + _NDCG.format("source", "r"))
def ndcg_at_5(spark, d):
    return ev.ndcg(judged(spark, d), ["source"], "rel", "a", "doc_id", 5).select("source", F.round("ndcg", 6).alias("ndcg"))


@query(f"""WITH {_J}, g AS (SELECT (a * 5 + b) AS k, a, b FROM (SELECT unnest(range(0, 5)) AS a) x, (SELECT unnest(range(0, 5)) AS b) y WHERE a + b <= 4),
gr AS (SELECT row_number() OVER (ORDER BY k) - 1 AS g, round(a * 0.25, 6)::DOUBLE AS wa, round(b * 0.25, 6)::DOUBLE AS wb, round((4 - a - b) * 0.25, 6)::DOUBLE AS wc FROM g),
s AS (SELECT source, doc_id, rel, g, round(wa * a + wb * b + wc * c, 9) AS s FROM j, gr),
r AS (SELECT *, row_number() OVER (PARTITION BY source, g ORDER BY s DESC, doc_id) AS p, row_number() OVER (PARTITION BY source, g ORDER BY rel DESC, doc_id) AS i FROM s),
m AS ({_NDCG.format('source, g', 'r')}), b AS (SELECT source, g, ndcg, row_number() OVER (PARTITION BY source ORDER BY ndcg DESC, g) AS k FROM m)
SELECT source, wa, wb, wc, ndcg FROM b JOIN gr USING (g) WHERE k = 1""")
def weight_grid(spark, d):
    """The grid weights of the best NDCG@5 for each source."""
    return ev.optimise(judged(spark, d), "source", ("a", "b", "c"), "rel", "doc_id", 5, 0.25)


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':0'), doc_id) AS r FROM documents) WHERE r <= CASE WHEN lang = 'en' THEN 5 ELSE 2 END")
def stratified_sample(spark, d):
    """A quota of each stratum, in a stable hashed order."""
    return ev.stratified(load(spark, d, "documents"), ["lang", "source"], "doc_id", F.when(F.col("lang") == "en", 5).otherwise(2)).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.2) AS is_test FROM documents")
def stratified_split(spark, d):
    return ev.split_share(load(spark, d, "documents"), "lang", "doc_id", 0.2).select("doc_id", "lang", "is_test")


@query("SELECT lang, n, target, round(abs(n - target) / target * 100, 4)::DOUBLE AS off_pct, abs(n - target) / target * 100 <= 5 AS ok FROM (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 600.0 ELSE 130.0 END::DOUBLE AS target FROM documents GROUP BY lang)")
def distribution_validation(spark, d):
    rows = load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("target", F.when(F.col("lang") == "en", 600.0).otherwise(130.0))
    off = F.abs(F.col("n") - F.col("target")) / F.col("target") * 100
    return rows.select("lang", "n", "target", F.round(off, 4).alias("off_pct"), (off <= 5).alias("ok"))


@query("SELECT source, round(avg(quality), 6) AS precision_, count(*) AS n, coalesce(round(avg(CASE WHEN quality = 1 THEN toxic END), 6), 1.0) AS toxic_share FROM labels JOIN documents USING (doc_id) GROUP BY source")
def context_precision(spark, d):
    """Relevant contexts over all, given judged flags; empty groups count 1."""
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("precision_"), F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))), 6), F.lit(1.0)).alias("toxic_share"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def benchmark_stats(spark, d):
    """Counts by language and source with subtotals."""
    return load(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query()
def greedy_matching(spark, d):
    """Turns of a conversation matched one to one by common words; tests compare it with a loop."""
    from tessera.functions import text as tx

    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(tx.words(F.col("text"))).alias("ws"))
    pred = rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("pred"), F.col("ws").alias("pw"))
    gold = rows.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("gold"), F.col("ws").alias("gw"))
    pairs = pred.join(gold, "conv_id").select("conv_id", "pred", "gold", tx.jaccard(F.col("pw"), F.col("gw")).alias("score"))
    return ev.greedy_match(pairs, "conv_id", "pred", "gold", "score", 0.01)
