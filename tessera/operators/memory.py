"""Scores of memories: decay, importance, relevance; eviction and consolidation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import similarity
from tessera.operators.analytics import ranks
from tessera.session import saved


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)


def half_life(days: Column, half: float) -> Column:
    """2^(-days / half), within 0 and 1; null for a missing age."""
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(F.lit(2.0), -days / half))))


def frequency(n: Column) -> Column:
    """1 - 1 / (1 + (n / 20)^2)."""
    return 1 - 1 / (1 + F.pow(n / 20.0, F.lit(2.0)))


def access_frequency(n: Column) -> Column:
    """min(1, ln(n + 1) / ln(101)), 0 for none."""
    return F.when(n > 0, F.least(F.lit(1.0), F.log(n + F.lit(1.0)) / F.log(F.lit(101.0)))).otherwise(F.lit(0.0))


def access_relevance(n: Column, days: Column, rating: Column) -> Column:
    return 0.3 * access_frequency(n) + 0.4 * half_life(days, 30) + 0.3 * F.coalesce(rating, F.lit(0.5))


def should_forget(importance: Column, ts: Column, now: Column, least: float = 0.3) -> Column:
    """importance * decay < least; missing importance is 1, a missing time keeps."""
    decayed = F.coalesce(importance, F.lit(1.0)) * half_life(age_days(ts, now), 30)
    return F.coalesce(decayed < least, F.lit(False))


def evict(rows: DataFrame, group: str, share: float, *order: Column) -> DataFrame:
    """The first max(1, int(share * n)) rows of each group in order: those that go."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_r", "_n")


def consolidated(memories: DataFrame, least: float = 0.95, share: float = 1.0) -> DataFrame:
    """Memories (id, embedding, relevance[, scope], ...) without later copies, the ``share`` of most relevance, with their rank.

    In the order of their unique ids a memory is kept if no kept one of its scope is as near as ``least``;
    one without a direction is always kept. Of these the most relevant go on, lesser ids first on
    ties, at least one. Ranks are dealt by range, so no task orders all of them.
    """
    members, reps = similarity.distinct_vectors(memories)
    nodes = reps.select("id", F.col("id").alias("place"))
    keeper = similarity.first_kept(similarity.near_pairs(reps, least), nodes)
    copies = members.filter("id <> rep").select("id").unionByName(keeper.filter("id <> keeper").select("id"))
    rows = memories.join(copies, "id", "left_anti").withColumns({"_g": F.lit(0), "_o": -F.coalesce("relevance", F.lit(0.0))})
    ranked = ranks(rows, ["_g"], "_o", "id").filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    return ranked.withColumnRenamed("_r", "rank").drop("_g", "_o", "_n")


def add_episodes(path: str, episodes: DataFrame, policy: Column | None = None) -> DataFrame:
    """Append episodes (id, ...) to the table at ``path``; (id, written, reason) of each.

    One that ``policy`` (of its columns) refuses is ``rejected``, one whose id the table has is
    ``known``, and of equal new ids one is written and the others are ``repeated``. The decisions
    are written beside the table, so asking for them again decides nothing anew.
    """
    spark = episodes.sparkSession
    fits = F.coalesce(policy if policy is not None else F.lit(True), F.lit(False))
    order = Window.partitionBy("id", "_fits").orderBy(*[F.col(c) for c in episodes.columns if c != "id"])
    rows = saved(episodes.withColumn("_fits", fits).withColumn("_n", F.row_number().over(order)))
    try:
        known = spark.read.parquet(path).select("id", F.lit(True).alias("_known")).distinct()
    except AnalysisException:  # no table yet
        known = spark.createDataFrame([], f"id {dict(episodes.dtypes)['id']}, _known boolean")
    reason = F.when(F.col("_known"), "known").when(~F.col("_fits"), "rejected").when(F.col("_n") > 1, "repeated")
    judged = saved(rows.join(known, "id", "left").withColumn("reason", reason).drop("_known"))
    judged.filter("reason IS NULL").select(*episodes.columns).write.mode("append").parquet(path)
    return judged.select("id", F.col("reason").isNull().alias("written"), "reason")
