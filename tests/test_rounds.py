"""Rounds over stored tables: the estimated size of a plan must not grow with their number."""

from pyspark.sql import functions as F

from tessera.session import stored


def test_estimates_do_not_multiply(spark):
    rows = spark.range(10).withColumn("x", F.col("id") % 3)
    for _ in range(12):
        rows = stored(rows.join(rows.groupBy("x").agg(F.count("*").alias("n")), "x").select("id", "x"))
    assert rows.count() == 10
    assert len(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8
