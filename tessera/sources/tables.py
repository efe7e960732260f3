"""Readers of the tables, and the roles that the driver's tables play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their JSON property ``k`` as a column."""
    return load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part edges (src, dst, weight) of the order lines, summed by their keys, which are shorter than names."""
    sums = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    return sums.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), "weight")


def supply_numbers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """An edge (src, dst, ...) for each order line with nodes as numbers: suppliers are even, parts odd; ``supply_name`` names them."""
    return load(spark, sf_dir, "lineitem").select((F.col("l_suppkey").cast("long") * 2).alias("src"), (F.col("l_partkey").cast("long") * 2 + 1).alias("dst"), *more)


def supply_name(number: str | Column) -> Column:
    """The name that ``supply_edges`` gives a node of ``supply_numbers``."""
    x = F.col(number) if isinstance(number, str) else number
    return F.concat(F.when(F.pmod(x, F.lit(2)) == 0, "s").otherwise("p"), F.shiftright(x, 1).cast("string"))
