"""Ranking metrics, weight search, deterministic sampling and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(rows: DataFrame, group: list[str], relevance: str, score: str, tie: str, k: int) -> DataFrame:
    """NDCG@k of each group: ties in score keep the order of ``tie``; 0 where nothing is relevant."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumns(
        {"_p": F.row_number().over(w.orderBy(F.desc(score), tie)), "_i": F.row_number().over(w.orderBy(F.desc(relevance), tie))}
    )
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col(relevance) / F.log2(F.col(place) + 1)).otherwise(0.0))
    sums = ranked.groupBy(*group).agg(gain("_p").alias("dcg"), gain("_i").alias("idcg"))
    return sums.select(*group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def weight_grid(step: float = 0.05) -> list[tuple[float, float, float]]:
    """Weights of three features on a simplex grid."""
    n = round(1 / step)
    return [(round(a * step, 6), round(b * step, 6), round((n - a - b) * step, 6)) for a in range(n + 1) for b in range(n + 1 - a)]


def optimise(rows: DataFrame, group: str, features: tuple[str, str, str], relevance: str, tie: str, k: int, step: float) -> DataFrame:
    """For each group the grid weights of the best NDCG@k, the first in grid order on ties.

    The grid is a small table (its size depends on the step alone).
    """
    grid = rows.sparkSession.createDataFrame([(n, *w) for n, w in enumerate(weight_grid(step))], "g int, wa double, wb double, wc double")
    a, b, c = features
    scored = rows.crossJoin(F.broadcast(grid)).withColumn("s", F.round(F.col("wa") * F.col(a) + F.col("wb") * F.col(b) + F.col("wc") * F.col(c), 9))
    metric = ndcg(scored, [group, "g"], relevance, "s", tie, k).withColumn("ndcg", F.round("ndcg", 6))
    best = metric.groupBy(group).agg(F.max(F.struct("ndcg", (-F.col("g")).alias("o")))["o"].alias("o"), F.max("ndcg").alias("ndcg"))
    return best.join(F.broadcast(grid), -F.col("o") == F.col("g")).select(group, "wa", "wb", "wc", "ndcg")


def place_of(key: Column, seed: int = 0) -> Column:
    """A stable pseudo-random order of rows: a hash of the key and a seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def stratified(rows: DataFrame, strata: list[str], key: str, quota: Column, seed: int = 0) -> DataFrame:
    """The first ``quota`` rows of each stratum in the stable order."""
    w = Window.partitionBy(*strata).orderBy(place_of(F.col(key), seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= quota).drop("_r")


def split_share(rows: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Marks a share of each label's rows as test rows."""
    w = Window.partitionBy(label)
    r = F.row_number().over(w.orderBy(place_of(F.col(key), seed), key))
    return rows.withColumn("is_test", r <= F.floor(F.count("*").over(w) * share))


def greedy_match(pairs: DataFrame, group: str, pred: str, gold: str, score: str, least: float) -> DataFrame:
    """One-to-one matches inside each group: every prediction in order takes the first free gold row that scores enough.

    A fold by nature; groups are single documents, so each is one small task.
    """

    def fold(frame):
        import pandas as pd

        taken, out = set(), []
        for p, own in frame[frame[score] >= least].sort_values([pred, gold]).groupby(pred, sort=True):
            free = [g for g in own[gold] if g not in taken]
            if free:
                taken.add(free[0])
                out.append((frame[group].iloc[0], p, free[0]))
        return pd.DataFrame(out, columns=[group, pred, gold])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {pred} {kinds[pred]}, {gold} {kinds[gold]}")
