"""Episodes, active domains and functions by name."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.registry import TEXT
from tessera.operators import filters, memory
from tessera.plans.registry import query
from tessera.session import shared_dir
from tessera.sources.tables import load


@query("""SELECT conv_id || '/' || turn AS id, turn % 2 = 1 AND length(text) >= 60 AS written, CASE WHEN turn % 2 = 0 AND length(text) >= 60 THEN 'known' WHEN length(text) < 60 OR text IS NULL THEN 'rejected' END AS reason FROM conversations""")
def episode_decisions(spark, d):
    """All turns added to a store that has the even ones; short ones are refused by the policy."""
    turns = load(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.col("role").alias("source"), "turn")
    path, policy = f"{shared_dir(spark)}/episodes-{uuid.uuid4().hex}", F.length("content") >= 60
    memory.add_episodes(path, turns.filter("turn % 2 = 0"), policy)
    return memory.add_episodes(path, turns, policy)


@query("""WITH asked AS (SELECT DISTINCT s_nationkey AS k FROM supplier), p AS (SELECT 'nation ' || k AS profile, k FROM asked)
SELECT profile, p_brand AS domain FROM p, (SELECT DISTINCT p_brand FROM part) WHERE k % 5 = 0 OR k % 5 = 1
UNION SELECT profile, p_brand FROM p JOIN part ON p_size = k WHERE k % 5 > 1""")
def active_brands(spark, d):
    """A nation's profile: all brands, an unknown profile (all too), or the brands of parts of its number's size."""
    k = F.col("s_nationkey")
    asked = load(spark, d, "supplier").select(F.concat(F.lit("nation "), k).alias("profile"), k.alias("k")).distinct()
    part = load(spark, d, "part")
    lists = asked.filter("k % 5 > 1").join(part, part["p_size"] == F.col("k"), "left").groupBy("profile").agg(F.collect_set("p_brand").alias("domains"))  # brands are few
    profiles = asked.filter("k % 5 = 0").select("profile", F.array(F.lit("ALL")).alias("domains")).unionByName(lists)
    return filters.active_domains(asked.select("profile"), profiles, part.select(F.col("p_brand").alias("domain")))


@query(r"""SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, ceil(length(text) / 3.0)::BIGINT AS tokens3, substr(text, 1, 20) AS beginning, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents""")
def functions_by_name(spark, d):
    """Registered functions applied by their names in one projection."""
    rows = TEXT.applied(
        load(spark, d, "documents"),
        tokens=("token_estimate", {"text": "text"}),
        tokens3=("token_estimate", {"text": "text", "per": 3}),
        beginning=("beginning", {"text": "text", "chars": 20}),
        words=("word_count", {"text": "text"}),
    )
    return rows.select("doc_id", "tokens", "tokens3", "beginning", "words")
