"""Keyword, dense and hybrid retrieval over DataFrames.

Queries are many at once: a table of (qid, ...) rows. Scores are rounded before they
are ranked, so that the order of float sums can't flip near ties; every ranking has a
key that makes it total.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text
from tessera.operators.analytics import running
from tessera.session import saved, stored

K1, B, RRF_K = 1.5, 0.75, 60
#: Queries of a block (texts, vectors), numbers of a matrix held at once.
QUERIES, VECTORS, CELLS = 1_000, 2_000, 1 << 22
#: Scores of vectors held at once.
SCORES = 1 << 20
#: Texts whose tokens a task holds at once.
TEXTS = 500


def terms_of(docs: DataFrame, id_: str = "doc_id", body: str = "text") -> DataFrame:
    """(id, term): a row for every token that is no stop word."""
    each = docs.select(F.col(id_).alias("id"), F.explode(F.split(F.lower(F.col(body)), r"\s+")).alias("term"))
    return each.filter((F.col("term") != "") & ~F.col("term").isin(*text.STOP_WORDS))


def term_counts(docs: DataFrame, id_: str = "doc_id", body: str = "text") -> DataFrame:
    """(id, terms, tfs): each id's distinct terms, as of ``terms_of``, and how often it has them; none without a term.

    A text's tokens are counted where it is read and never shuffled; texts of an id that is there again are put together first.
    """
    rows = docs.select(F.col(id_).alias("id"), F.col(body).alias("text"))
    again = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_id"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        merged = rows.join(again, same, "left_semi").groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
        rows = rows.join(again, same, "left_anti").unionByName(merged)
    stop = pa.array(["", *text.STOP_WORDS])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column("ts")), 0))
                coded = batch.column("ts").flatten().dictionary_encode()
                doc, code, words = np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                keep = ~np.asarray(pa.compute.is_in(words, value_set=stop))[code] if len(code) else np.zeros(0, bool)
                key, tf = np.unique(doc[keep] * max(len(words), 1) + code[keep], return_counts=True)
                own = np.bincount(key // max(len(words), 1), minlength=len(sizes))
                ends = pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, words.take(pa.array(key % max(len(words), 1))))
                out = [batch.column("id"), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "terms", "tfs"]).filter(pa.array(own > 0))

    split = rows.select("id", F.split(F.lower("text"), r"\s+").alias("ts"))
    return split.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, terms array<string>, tfs array<int>")


def blocks_of(queries: DataFrame, rows: int = QUERIES) -> list[DataFrame]:
    """The queries in blocks of about ``rows``; each block is bounded, and meets all documents."""
    n = max(1, -(-queries.count() // rows))
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)]


def all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score, rank) of the ``k`` best documents of every query (qid, text), later ids first on ties."""
    return top(bm25(docs, queries, k1, b, k), k, tie_desc=True)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, k: int | None = None) -> DataFrame:
    """(qid, id, score) of every document that shares a term with a query (qid, text), or of the ``k`` best at least.

    idf = ln(1 + (n - df + 0.5) / (df + 0.5)). The documents are read once for a block
    of queries: a document's tokens become its length and its query terms in one
    aggregate. Batches of documents then meet the queries as matrices, and only each
    batch's best go on.
    """
    def block(part: DataFrame) -> DataFrame:
        wanted, of_query = _asked(part)
        terms = docs.sparkSession.createDataFrame(list(wanted.items()) or [("", 0)], "term string, t int")
        found = terms_of(docs).join(F.broadcast(terms), "term", "left")  # bounded with its block
        found = saved(found.groupBy("id").agg(F.count("*").alias("dl"), F.collect_list("t").alias("ts")))
        stats = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        return _scored(found, wanted, of_query, stats["n"], stats["avgdl"], k, k1, b)

    return all_of([block(part) for part in blocks_of(queries)])


def _asked(queries: DataFrame) -> tuple[dict[str, int], dict]:
    """A block's terms by number, and the numbers of each query."""
    rows = queries.select("qid", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).collect()
    wanted = {term: i for i, term in enumerate(sorted({r["term"] for r in rows}))}
    of_query: dict = {}
    for r in rows:
        of_query.setdefault(r["qid"], []).append(wanted[r["term"]])
    return wanted, of_query


def _scored(found: DataFrame, wanted: dict[str, int], of_query: dict, n: int, avgdl: float, k: int | None, k1: float, b: float) -> DataFrame:
    """Each batch's best rows (qid, id, score) of documents (id, dl, ts: numbers of query terms, repeated as in the text)."""
    spark, width = found.sparkSession, len(wanted)
    df = np.zeros(max(width, 1))
    for r in found.select(F.explode(F.array_distinct("ts")).alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    qids = list(of_query)
    asks = np.zeros((len(df), len(qids)), bool)
    for q, qid in enumerate(qids):
        asks[of_query[qid], q] = True
    shared = spark.sparkContext.broadcast((np.log(1 + (n - df + 0.5) / (df + 0.5)), asks))
    words = bool(qids) and isinstance(qids[0], str)
    kinds = {"id": found.schema["id"].dataType, "qid": "string" if words else "long"}
    names = pa.array(qids, pa.string() if words else pa.int64())

    def run(batches):
        idf, ask = shared.value
        ask = ask.astype(np.float64)
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CELLS // len(idf))):
                batch = whole.slice(at, max(1, CELLS // len(idf)))
                ts = batch.column("ts")
                sizes = np.asarray(pa.compute.list_value_length(ts))
                doc, t = np.repeat(np.arange(len(sizes)), sizes), ts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = np.bincount(doc * len(idf) + t, minlength=len(sizes) * len(idf)).reshape(len(sizes), len(idf)).astype(np.float64)
                dl = batch.column("dl").to_numpy().astype(np.float64)[:, None]
                score = np.round((idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) @ ask, 6)
                yield from best_of(batch.column("id"), names, score, score > 0, k)

    return found.mapInArrow(run, f"qid {kinds['qid']}, id {kinds['id'].simpleString()}, score double")


def best_of(ids: pa.Array, qids: pa.Array, score: np.ndarray, fits: np.ndarray, k: int | None):
    """Of a batch's scores (rows x queries), rows with a query's k-th best score or a better one (no k: all that fit)."""
    score = np.where(fits, score, -np.inf)
    least = np.partition(score, -k, axis=0)[-k] if k and len(score) > k else np.full(score.shape[1], -np.inf)
    row, q = np.nonzero(fits & (score >= least))
    if len(row):
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(row)), pa.array(score[row, q])], names=["qid", "id", "score"])


def write_index(docs: DataFrame, path: str, parts: int = 64) -> None:
    """Postings (term, id, tf) and lengths (id, dl) as Parquet; postings are dealt to ``parts`` folders by term."""
    counts = stored(term_counts(docs))
    each = counts.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    each.withColumn("part", part).repartition("part").sortWithinPartitions("term").write.partitionBy("part").parquet(f"{path}/postings")
    counts.select("id", F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("dl")).write.parquet(f"{path}/lengths")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, parts: int = 64, k1: float = K1, b: float = B) -> DataFrame:
    """As ``bm25_top``, from a written index: only the folders of the queries' terms are read."""
    postings, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()

    def block(part: DataFrame) -> DataFrame:
        wanted, of_query = _asked(part)
        terms = spark.createDataFrame(list(wanted.items()) or [("", 0)], "term string, t int")
        folders = [r["part"] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")).distinct().collect()]
        own = postings.filter(F.col("part").isin(folders)).join(F.broadcast(terms), "term")
        own = own.groupBy("id").agg(F.flatten(F.collect_list(F.array_repeat("t", F.col("tf").cast("int")))).alias("ts"))
        return _scored(saved(own.join(lengths, "id")), wanted, of_query, stats["n"], stats["avgdl"], k, k1, b)

    return top(all_of([block(part) for part in blocks_of(queries)]), k, tie_desc=True)


def top(scored: DataFrame, k: int, by: str = "score", tie: str = "id", tie_desc: bool = False, group: str = "qid") -> DataFrame:
    """The ``k`` best rows of each group with their rank from 1."""
    order = Window.partitionBy(group).orderBy(F.desc(by), F.desc(tie) if tie_desc else F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(points: DataFrame, queries: DataFrame, least: float | None = None) -> DataFrame:
    """(qid, id, score) of every point (id, embedding) of a query's size for every query (qid, q_embedding): exact cosine.

    All pairs, or those of ``least`` at least: for few queries (centres).
    """
    return _nearest(points, queries, None, least, False, VECTORS)


def knn_top(points: DataFrame, queries: DataFrame, k: int, scoped: bool = False, rows: int = VECTORS) -> DataFrame:
    """(qid, id, score, rank) of the ``k`` nearest points, see ``_nearest``."""
    return top(_nearest(points, queries, k, None, scoped, rows), k)


def knn_within(points: DataFrame, queries: DataFrame, least: float, rows: int = VECTORS) -> DataFrame:
    """(qid, id, score) of the points of a query's scope at ``least`` or nearer, without the query itself."""
    return _nearest(points, queries, None, least, True, rows)


def _nearest(points: DataFrame, queries: DataFrame, k: int | None, least: float | None, scoped: bool, rows: int) -> DataFrame:
    """(qid, id, score) of the ``k`` nearest points (id, embedding[, scope]) of every query (qid, q_embedding[, scope]).

    Exact cosine, 0 for a zero vector. A block of queries is broadcast as a matrix and
    meets all points in batches, of which only the best go on. ``scoped``: only points
    of the query's scope, without the query itself (id = qid).
    """
    names = ["scope"] if scoped else []
    kind, asked = points.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType
    names_of = to_arrow_type(asked)

    def block(part: DataFrame) -> DataFrame:
        own = part.select("qid", F.col("q_embedding").cast("array<double>").alias("v"), *names).collect()
        by_size: dict[int, list] = {}
        for r in own:
            if r["v"]:
                by_size.setdefault(len(r["v"]), []).append(r)
        made = {d: ([r["qid"] for r in rs], _units(np.array([r["v"] for r in rs])), [r["scope"] for r in rs] if scoped else None) for d, rs in by_size.items()}
        shared = points.sparkSession.sparkContext.broadcast(made)

        def run(batches):
            for batch in batches:
                size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column("v")), 0))
                for d, (qids, unit, scope) in shared.value.items():
                    for at in _cut(np.flatnonzero(size == d), max(1, SCORES // max(len(qids), d))):
                        rows = batch.take(pa.array(at))
                        x = _units(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
                        score = np.round(x @ unit.T, 6)
                        fits = np.ones(score.shape, bool) if least is None else score >= least
                        if scoped:
                            fits &= _same(rows.column("scope").to_pylist(), scope) & ~_same(rows.column("id").to_pylist(), qids)
                        yield from best_of(rows.column("id"), pa.array(qids, names_of), score, fits, k)

        # components are finite or the row has no neighbours
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        read = points.select("id", F.col("embedding").cast("array<double>").alias("v"), *names).filter(fine)
        return read.mapInArrow(run, f"qid {asked.simpleString()}, id {kind}, score double")

    return all_of([block(part) for part in blocks_of(queries, rows)])


def _same(a: list, b: list) -> np.ndarray:
    """Which of ``a`` equal which of ``b``, met as whole numbers."""
    code = {x: k for k, x in enumerate(dict.fromkeys(b))}
    return np.array([code.get(x, -1) for x in a], np.int32)[:, None] == np.array([code[x] for x in b], np.int32)[None, :]


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _cut(at: np.ndarray, most: int):
    return [at[k : k + most] for k in range(0, len(at), most)]


def fuse(channels: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (qid, id, rank): sum of w / (k + rank)."""
    weights = weights or [1.0] * len(channels)
    every = None
    for channel, weight in zip(channels, weights):
        part = channel.select("qid", "id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def normalised(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [w / total for w in weights]


def entity_boost(fused: DataFrame, ranked_entities: DataFrame, mentions: DataFrame, alpha: float = 0.3, k: int = RRF_K) -> DataFrame:
    """score + alpha * sum of 1 / (k + entity rank) over the query's entities that a chunk mentions."""
    boost = ranked_entities.join(mentions, "entity").groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("entity_rank"))).alias("boost"))
    out = fused.join(boost, ["qid", "id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("final_score", F.round(F.col("score") + alpha * F.col("boost"), 9))


def expand(found: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """(qid, id, overlap): chunks that share most entities with a query's found chunks (qid, id), without these."""
    seen = found.join(mentions, "id").select("qid", "entity").distinct()
    near = seen.join(mentions, "entity").groupBy("qid", "id").agg(F.count("*").alias("overlap")).join(found, ["qid", "id"], "left_anti")
    return top(near, k, by="overlap").select("qid", "id", "overlap")


def first_by(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key."""
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(place)).filter("_r = 1").drop("_r")


def dedup_contexts(rows: DataFrame, *order: Column, body: str = "text", chars: int = 200) -> DataFrame:
    """One row for each normalised beginning; rows with an empty one go."""
    key = F.lower(F.trim(F.substring(body, 1, chars)))
    return first_by(rows.withColumn("_key", key).filter("_key <> ''"), F.col("_key"), *order).drop("_key")


def dedup_fused(rows: DataFrame, seq: str = "seq", url: str = "url", body: str = "text", chars: int = 200) -> DataFrame:
    """Rows whose url and text beginning no earlier row has; empty keys never match."""
    begin = F.lower(F.trim(F.substring(body, 1, chars)))
    first = lambda key: F.when(key == "", F.col(seq)).otherwise(F.min(seq).over(Window.partitionBy(key)))
    marked = rows.withColumn("_u", F.coalesce(url, F.lit(""))).withColumn("_t", F.coalesce(begin, F.lit("")))
    marked = marked.withColumn("_fu", first(F.col("_u"))).withColumn("_ft", first(F.col("_t")))
    return marked.filter((F.col("_fu") == F.col(seq)) & (F.col("_ft") == F.col(seq))).drop("_u", "_t", "_fu", "_ft")


def within_budget(rows: DataFrame, budget: int, group: str, *order: Column, cost: Column) -> DataFrame:
    """Rows of each group in order while their running cost stays in the budget (it stops at the first overflow)."""
    return running(rows, group, list(order), cost, "used").filter(F.col("used") <= budget)


def merged_sizes(found: DataFrame, query: str, part: str) -> DataFrame:
    """Rows of a query's sub-results put together, and of the fullest of them (the first of equals)."""
    sizes = found.groupBy(query, part).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(part)).alias("o")))["n"]
    return sizes.groupBy(query).agg(F.sum("n").alias("concatenated"), best.alias("best"))


def merged_rows(found: DataFrame, query: str, part: str, k: int = RRF_K) -> DataFrame:
    """(strategy, query, place, id) of sub-results (query, part, id, rank) merged in three ways, each with its order.

    ``concat``: one part after another, an id as often as it was found; ``best``: the fullest
    part (the first of equals); ``rrf``: by summed reciprocal ranks, lesser ids first on ties.
    """
    def ordered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(query).orderBy(*order))  # a query's few results
        return rows.select(F.lit(name).alias("strategy"), query, place.alias("place"), "id")

    sizes = found.groupBy(query, part).agg(F.count("*").alias("_n"))
    fullest = sizes.groupBy(query).agg(F.max(F.struct("_n", (-F.col(part)).alias("o")))["o"].alias("_o")).select(query, (-F.col("_o")).alias(part))
    scores = found.groupBy(query, "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("_s"))
    concat = ordered(found, "concat", F.col(part), F.col("rank"), F.col("id"))
    best = ordered(found.join(fullest, [query, part]), "best", F.col("rank"), F.col("id"))
    return concat.unionByName(best).unionByName(ordered(scores, "rrf", F.desc("_s"), F.col("id")))


def holding(texts: DataFrame, terms: DataFrame, body: str, term: str) -> DataFrame:
    """Pairs of texts and terms that they hold as they stand (lower-cased).

    The terms come in blocks that are broadcast as one row. What stands between two spaces of a
    term is a word between spaces of each text that holds it, so a text is split once a block
    and searched only for terms whose second word it has, and for those of one or two words.
    """
    def block(part: DataFrame) -> DataFrame:
        pieces = F.split(term, " ")
        words = part.groupBy(term).agg(F.collect_list(F.struct(*part.columns)).alias("t"))
        words = words.select(F.when(F.size(pieces) > 2, F.get(pieces, F.lit(1))).alias("inner"), F.struct(F.col(term).alias("w"), "t").alias("x"))
        keyed = words.groupBy("inner").agg(F.collect_list("x").alias("xs"))
        known = F.col("inner").isNotNull()
        by = F.map_from_entries(F.collect_list(F.when(known, F.struct("inner", "xs"))))
        one = keyed.agg(by.alias("_by"), F.flatten(F.collect_list(F.when(~known, F.col("xs")))).alias("_short"))  # a bounded block

        def found(low: Column) -> Column:
            near = F.array_intersect(F.split(low, " "), F.map_keys("_by"))
            tried = F.concat(F.flatten(F.transform(near, lambda w: F.element_at("_by", w))), F.col("_short"))
            return F.filter(tried, lambda x: low.contains(x["w"]))

        # a lambda holds the lowered text, which would be lowered for each term otherwise
        hit = F.flatten(F.transform(F.array(F.lower(F.col(body))), found))
        rows = texts.crossJoin(F.broadcast(one)).withColumn("_hit", F.explode(F.flatten(F.transform(hit, lambda x: x["t"]))))
        return rows.select(*[c for c in texts.columns], *[F.col("_hit")[c].alias(c) for c in part.columns])

    keyed = terms.withColumn("qid", F.xxhash64(term))
    return all_of([block(part.drop("qid")) for part in blocks_of(keyed)])
