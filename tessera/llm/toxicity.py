"""Toxicity by weak supervision: pattern voters, a generative label model, a linear classifier.

1. Patterns are words and beginnings of words (``LENGTHS`` bytes), lower-cased. Their
   document counts among labelled rows that may be learnt from give those that go
   with the label; the strongest that are not mere variants of each other are the
   voters and the classifier's features. A voter fires or abstains, and abstaining
   says nothing; only that no voter fires at all counts, as one voter more.
2. The voters' joint firing counts over all documents (a voters x voters matrix, so
   its size is fixed) fit the generative model: P(i and j fire) = p a_i a_j +
   (1-p) b_i b_j, with a, b the firing rates in toxic and other documents, started
   from the labelled rows. Pairs that fire together more than their classes explain
   are taken as dependent: they don't enter the fit, and their weight is shared.
3. The posterior of the model labels all documents (grouped by the voters that fire,
   which together weigh ``UNLABELLED`` rows) and the labelled sample (a known label
   counts as one more, nearly certain voter); a logistic regression learns it by
   Newton steps whose sums are taken over the groups where they lie.

Scores take the text only. The labelled rows fitted on are bounded by ``MOST_TOXIC``
and ``MOST_CLEAN``; the firing counts and the regression cover all documents.

Edge cases: null and empty text has no pattern and scores by the intercept alone;
without labels of both kinds the model is empty and every score is 0; of repeated
labels of a document the largest counts, and so it does of near copies among the
labelled rows, of which one is learnt (least doc_id, then text, where labels tie);
repeated rows are scored each by itself; rows without doc_id count as held out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeing, held_out, sample_below, table, written

MOST_TOXIC, MOST_CLEAN = 8_000, 16_000
#: Rows that all documents together weigh in the regression.
UNLABELLED = 8_000
LENGTHS = (3, 4, 5, 6)
FEATURES = 256
#: Whole words of more bytes are named by their first bytes and a hash.
LONG_WORD = 32
THRESHOLD = 0.7
#: Least log odds of a pattern, and least lower bound of them (5 %).
LEAST_LOG_ODDS, LEAST_SURE = 3.0, 1.8

_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def folded(text: str | None) -> str:
    """Lower-cased text, one character a byte, each word after a space."""
    return (b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ").decode("latin-1") if text else ""


_LONG = re.compile(r"[^ ]{%d,}" % (LONG_WORD + 1))


def long_name(word: str) -> str:
    """The pattern that stands for a long whole word; the mark in it is in no word."""
    return f"{word[:LONG_WORD]}#{hash_of(word):x}"


def patterns_of(text: str | None) -> set[str]:
    words = set(folded(text).split())
    whole = {w + " " if len(w) <= LONG_WORD else long_name(w) for w in words}
    return {w[:n] for w in words for n in LENGTHS if len(w) >= n} | whole


@dataclass
class Model:
    """Patterns, their weights, and the voters' part of it (for reports)."""

    patterns: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -np.inf
    voters: pd.DataFrame | None = None

    def automaton(self):
        import ahocorasick

        found, long = ahocorasick.Automaton(), {}
        for k, p in enumerate(self.patterns):
            if "#" in p:
                long[p] = k
            else:
                found.add_word(" " + p, k)
        if len(found):
            found.make_automaton()
        return found, long


def fired(text: str | None, automaton) -> list[int]:
    """Numbers of the patterns that begin, or are, a word of the text."""
    found, long = automaton
    if not text or not (len(found) or long):
        return []
    text = folded(text)
    out = {k for _, k in found.iter(text)} if len(found) else set()
    if long:
        out |= {long[p] for p in map(long_name, _LONG.findall(text)) if p in long}
    return sorted(out)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of rows to learn from, with text and label."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [
        sample_below(known.filter(F.col("label") == y), counts.get(y, 0), most)
        for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))
    ]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by the two parameters
    found = docs.select("doc_id", "text").join(ids, "doc_id")
    found = found.withColumn("k", F.pandas_udf(_copy_keys, "array<long>")("text")).withColumns({"k0": F.col("k")[0], "k1": F.col("k")[1]}).drop("k")
    rank = F.struct(F.col("label"), -F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "k1", "text", "doc_id")
    for key in ("k0", "k1"):
        found = found.groupBy(key).agg(F.max(rank).alias("one")).select(key, "one.label", "one.doc_id", "one.text", *(["one.k1"] if key == "k0" else []))
    return written(found.select("doc_id", "text", "label"), "labelled")


def _copy_keys(texts: pd.Series) -> pd.Series:
    """Two least hashes of a text's word triples: mostly equal for near copies, which teach nothing more."""

    def keys(text: str | None) -> list[int]:
        w = folded(text).split()
        triples = {hash_of(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))}
        return [min(triples), min(t * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF for t in triples)]

    return texts.map(keys)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("latin-1")) >> 1


def _mine(labelled: DataFrame) -> tuple[list[tuple], tuple[int, int]]:
    """(pattern, toxic documents, other documents) of associated patterns, strongest first, and the two classes' sizes."""

    n1, n0 = labelled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = n1 or 0, n0 or 0
    if not n1 or not n0:
        return [], (n1, n0)

    def count(texts: DataFrame, known) -> DataFrame:
        def run(frames):
            by: Counter = Counter()
            for frame in frames:
                for text in frame["text"]:
                    own = patterns_of(text)
                    by.update(own if known is None else own & known.value)
            yield pd.DataFrame({"p": pd.Series(list(by), dtype=object), "n": list(by.values())})

        return texts.select("text").mapInPandas(freeing(run), "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))

    toxic = {r["p"]: r["n"] for r in count(labelled.filter("label = 1"), None).filter("n >= 3").collect()}
    shared = labelled.sparkSession.sparkContext.broadcast(frozenset(toxic))  # of at most MOST_TOXIC documents
    clean = {r["p"]: r["n"] for r in count(labelled.filter("label = 0"), shared).collect()}
    found = []
    for p, m1 in toxic.items():
        m0 = clean.get(p, 0)
        odds = np.log((m1 + 0.5) / (n1 + 1)) - np.log((m0 + 0.5) / (n0 + 1))
        sure = odds - 1.64 * np.sqrt(1 / (m1 + 0.5) + 1 / (m0 + 0.5))
        if odds >= LEAST_LOG_ODDS and sure >= LEAST_SURE:
            found.append((-round(sure, 6), -len(p), p, m1, m0))
    found = [x[2:] for x in sorted(found)]
    shared = labelled.sparkSession.sparkContext.broadcast([p for p, _, _ in found])

    def own(frames):
        number = {p: k for k, p in enumerate(shared.value)}
        for frame in frames:
            yield pd.DataFrame({"got": [sorted(number[p] for p in patterns_of(t) if p in number) for t in frame["text"]]})

    rows = labelled.filter("label = 1").select("text").mapInPandas(freeing(own), "got array<int>").collect()
    return _distinct(found, [r["got"] for r in rows]), (n1, n0)


def _distinct(found: list[tuple], toxic: list[list[int]]) -> list[tuple]:
    """Patterns worth keeping, in order of strength.

    Left out are those that extend or begin an earlier one and are about as frequent,
    and weaker ones whose toxic documents (``toxic``: pattern numbers of each) are all
    explained by earlier ones: words that only stand beside.
    """
    rows_of: dict[int, list[int]] = {}
    for r, got in enumerate(toxic):
        for k in got:
            rows_of.setdefault(k, []).append(r)
    covered, chosen = np.zeros(len(toxic), bool), []
    for k, (p, m1, m0) in enumerate(found):
        if len(chosen) == FEATURES:
            break
        rows = rows_of.get(k, [])
        strong = m1 >= 10 and m0 <= 0.02 * m1
        if not strong and (~covered[rows]).sum() < 1:
            continue
        if not any((p.startswith(q) or q.startswith(p)) and abs(m1 - k1) <= 0.1 * max(m1, k1) for q, k1, _ in chosen):
            chosen.append((p, m1, m0))
            covered[rows] = True
    return chosen


def _firing_counts(docs: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """Over all documents: how often each pair of voters fires together, and the documents."""
    m = len(model.patterns)
    shared = docs.sparkSession.sparkContext.broadcast(model.patterns)

    def count(frames):
        automaton = Model(shared.value).automaton()
        together, n = np.zeros((m, m), np.int64), 0
        for frame in frames:
            n += len(frame)
            for text in frame["text"]:
                got = fired(text, automaton)
                if got:
                    together[np.ix_(got, got)] += 1
        i, j = np.nonzero(together)
        yield pd.DataFrame({"i": [*i, -1], "j": [*j, -1], "n": [*together[i, j], n]})

    rows = docs.select("text").mapInPandas(freeing(count), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros((m, m)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            out[r["i"], r["j"]] = r["n"]
    return out, n


def fit_label_model(together: np.ndarray, n: int, a0: np.ndarray, b0: np.ndarray, prior: float, steps: int = 400):
    """Firing rates a, b of the voters in both classes and the matrix of dependent pairs.

    Least squares on the pairwise moments, with the labelled rows' rates as a weak anchor.
    """
    m = len(a0)
    p2 = together / max(n, 1)
    p1 = np.diag(p2)
    a, b = a0.copy(), b0.copy()
    expect = lambda: prior * np.outer(a, a) + (1 - prior) * np.outer(b, b)
    spread = np.sqrt(np.maximum(np.outer(p1, p1) * n, 1)) / max(n, 1)
    dependent = (p2 - expect() > 4 * spread + 0.5 * np.minimum(p1[:, None], p1[None, :])) & ~np.eye(m, dtype=bool)
    weight = (~dependent & ~np.eye(m, dtype=bool)) / np.maximum(p1.mean(), 1e-6) ** 1.5
    rate = 0.05
    for _ in range(steps):
        gap = weight * (expect() - p2)
        own = (prior * a + (1 - prior) * b - p1) / np.maximum(p1, 1e-6)
        ga = prior * (gap @ a) / max(m, 1) + prior * own + 0.05 * (a - a0)
        gb = (1 - prior) * (gap @ b) / max(m, 1) + (1 - prior) * own * b / np.maximum(a + b, 1e-9) + 0.05 * (b - b0)
        a, b = np.clip(a - rate * a0 * np.clip(ga, -1, 1), 1e-4, 0.999), np.clip(b - rate * b0 * np.clip(gb, -1, 1), 1e-6, 0.999)
    return a, b, dependent


def posterior(votes: np.ndarray, a: np.ndarray, b: np.ndarray, dependent: np.ndarray, prior: float, known: np.ndarray, quiet: float) -> np.ndarray:
    """P(toxic) of rows of 0/1 votes; ``known``: the label, or -1; ``quiet``: log odds where no voter fires.

    Dependent voters that fire share one weight.
    """
    shared = 1 / (1 + votes @ dependent)
    none = votes.sum(axis=1) == 0
    log_odds = np.log(prior / (1 - prior)) + (votes * shared) @ np.log(a / b) + none * quiet
    log_odds = log_odds + np.where(known < 0, 0, np.where(known == 1, 6.0, -6.0))
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def newton_sums(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted logistic loss of soft targets at ``w`` (the last entry is the intercept)."""
    x = np.column_stack((votes, np.ones(len(votes))))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - target)), (x * (weight * p * (1 - p))[:, None]).T @ x


def fit_linear(rows: DataFrame, k: int, target, l2: float = 0.1, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression of ``target(votes, known)`` on groups (got, label, weight), by damped Newton steps.

    A step is one pass over the groups; a task hands on one gradient and one Hessian.
    """
    w, penalty = np.zeros(k + 1), np.full(k + 1, l2)
    w[k], penalty[k] = -2.0, 1e-6
    upper = np.triu_indices(k + 1)
    for _ in range(steps):

        def run(frames, w=w):
            grad, hessian = np.zeros(k + 1), np.zeros((k + 1, k + 1))
            for frame in frames:
                votes = np.zeros((len(frame), k))
                for r, got in enumerate(frame["got"]):
                    votes[r, got] = 1
                g, h = newton_sums(votes, target(votes, frame["label"].to_numpy()), frame["weight"].to_numpy(), w)
                grad, hessian = grad + g, hessian + h
            yield pd.DataFrame({"at": [0], "s": [np.concatenate((grad, hessian[upper]))]})

        parts = rows.mapInPandas(freeing(run), "at int, s array<double>").select(F.posexplode("s").alias("at", "x"))
        sums = parts.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()
        grad, hessian = sums[: k + 1] + penalty * w, np.zeros((k + 1, k + 1))
        hessian[upper] = sums[k + 1 :]
        hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty + 1e-6)
        step = np.clip(np.linalg.solve(hessian, grad), -3, 3)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    labelled = _labelled(docs, labels)
    found, (n1, n0) = _mine(labelled)
    if not found:
        return Model()
    model = Model([p for p, _, _ in found])
    together, n = _firing_counts(docs, model)
    a0 = np.array([(x[1] + 0.5) / (n1 + 1) for x in found])
    b0 = np.array([(x[2] + 0.5) / (n0 + 1) for x in found])
    truth = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = float(np.clip(truth, 0.001, 0.5))
    a, b, dependent = fit_label_model(together, n, a0, b0, prior)
    rows = _grouped(docs, labelled, model, n)
    quiet = _quiet(rows)
    model.weights, model.intercept = fit_linear(rows, len(found), lambda votes, known: posterior(votes, a, b, dependent, prior, known, quiet))
    model.voters = pd.DataFrame({"pattern": model.patterns, "a": a, "b": b, "dependent": dependent.sum(0)})
    return model


def _quiet(rows: DataFrame) -> float:
    """Log odds of the label where no voter fires, from the labelled rows."""
    none = F.size("got") == 0
    sums = rows.filter("label >= 0").groupBy("label").agg(F.sum(F.when(none, F.col("weight")).otherwise(0)), F.sum("weight")).collect()
    of = {r[0]: np.log(r[1] + 0.5) - np.log(r[2] + 1) for r in sums}
    return float(of.get(1, 0) - of.get(0, 0))


def _grouped(docs: DataFrame, labelled: DataFrame, model: Model, n: int) -> DataFrame:
    """(got, label, weight): the sets of voters that fire, of all documents (label -1) and of the labelled rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model.patterns)

    def find(frames):
        automaton = Model(shared.value).automaton()
        for frame in frames:
            yield pd.DataFrame({"got": [fired(t, automaton) for t in frame["text"]], "label": frame["label"]})

    rest = docs.select(F.col("text").cast("string").alias("text"), F.lit(-1).alias("label"))
    rows = labelled.select("text", "label").unionByName(rest).mapInPandas(freeing(find), "got array<int>, label int")
    own = F.when(F.col("label") < 0, F.count("*") * (UNLABELLED / max(n, 1))).otherwise(F.count("*").cast("double"))
    return written(rows.groupBy("got", "label").agg(own.alias("weight")), "votes")


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a text column."""
    shared = spark.sparkContext.broadcast((model.patterns, model.weights, model.intercept))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        patterns, weights, intercept = shared.value
        automaton = _automaton(tuple(patterns))
        out = np.array([intercept + weights[fired(t, automaton)].sum() for t in texts], float)
        with np.errstate(over="ignore"):
            return pd.Series(1 / (1 + np.exp(-out)))

    return score


_KEPT: dict = {}


def _automaton(patterns: tuple):
    if patterns not in _KEPT:
        _KEPT.clear()
        _KEPT[patterns] = Model(list(patterns)).automaton()
    return _KEPT[patterns]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows: held_out, score and the thresholded prediction of every document."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    return docs.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    return docs.filter(scorer(docs.sparkSession, fit(docs, labels))(F.col("text").cast("string")) < THRESHOLD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
