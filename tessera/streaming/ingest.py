"""A stream of documents to chunks, vectors and an index; a chunk that fails is set aside and stops nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(docs: DataFrame, size: int = 1000) -> DataFrame:
    """(doc_id, chunk_no, text): consecutive pieces of ``size`` characters; empty texts have none."""
    n = F.ceil(F.length("text") / size).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    rows = docs.select("doc_id", "text", F.explode(numbers).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("text"))


def embedded(chunks: DataFrame, embed: Callable[[str], list[float]], tries: int = 3) -> DataFrame:
    """Chunks with ``embedding`` or, after ``tries`` failures, with ``error``; ``tried`` counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for text in frame["text"]:
                vector, error, k = None, None, 0
                while vector is None and k < tries:
                    k += 1
                    try:
                        vector = [float(x) for x in embed(text)]
                    except Exception as problem:  # a failure belongs to its chunk
                        error = str(problem)
                made.append((vector, None if vector is not None else error, k))
            yield frame.assign(embedding=[m[0] for m in made], error=[m[1] for m in made], tried=[m[2] for m in made])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{kinds}, embedding array<double>, error string, tried int")


def ingest(docs: DataFrame, embed: Callable[[str], list[float]], good: str, bad: str, checkpoint: str, size: int = 1000):
    """Drain a stream of documents (doc_id, text) into a table of vectors and one of failed chunks; returns the query.

    A micro-batch that is repeated after a failure replaces its own folder, so chunks are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter("error IS NOT NULL").drop("embedding").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    rows = embedded(chunked(docs, size), embed)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, key: str, ts: str, done: str, total: str) -> DataFrame:
    """The latest progress of each document: percent of ``done`` over ``total``, and whether it is complete."""
    last = F.max(F.struct(ts, done, total)).alias("last")
    rows = events.groupBy(key).agg(last, F.count("*").alias("n_events"))
    percent = F.when(F.col(f"last.{total}") > 0, F.round(100 * F.col(f"last.{done}") / F.col(f"last.{total}"), 2)).otherwise(0.0)
    return rows.select(key, "n_events", F.col(f"last.{ts}").alias("at"), percent.alias("percent"), (F.col(f"last.{done}") >= F.col(f"last.{total}")).alias("complete"))
