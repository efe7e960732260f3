"""A training corpus from ``documents``: toxicity, near copies, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's result in the shared folder, reads it back for the next one, and deletes a
result when the next one is written.

Some stages learn or search approximately (weak supervision, sketches, a field), so
no SQL gives the same rows: ``ORACLE_SQL`` is None, and the tests hold the stages
against brute-force versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near_dedup, packing, pii, toxicity
from tessera.llm.common import consumed, lean, table, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels of the documents still there are learnt from."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lies in benchmark passages."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; every document stays."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and the sequences they are packed to."""
    return packing.packed(docs)


def _lean(stage):
    """``stage`` with small Arrow batches, so that its workers' memory stays bounded."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _lean(drop_toxic)),
    ("near_dedup", _lean(drop_near_copies)),
    ("decontamination", _lean(drop_contaminated)),
    ("pii", _lean(mask_personal_data)),
    ("packing", _lean(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            consumed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
