"""The pipeline's stages, each held against its operator or a brute-force version on its own input."""

import __spark_entry__
import corpus_pipeline
import pytest
from tessera.llm import decontaminate, near_dedup, pii
from tessera.llm.common import table, written


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, sf), name)
        out.append((name, docs, new))
        docs = new
    return {name: (a, b) for name, a, b in out}


def test_order_and_columns(steps):
    assert list(steps) == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name, (a, b) in steps.items():
        if name != "packing":
            assert b.columns == a.columns


def test_near_copies(steps):
    before, after = steps["near_dedup"]
    want = near_dedup.brute_force([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, (_, _, kept) in want.items() if kept}


def test_benchmark_passages(spark, sf, steps):
    before, after = steps["decontamination"]
    want = decontaminate.brute_force([(r.doc_id, r.text) for r in before.collect()], [tuple(r) for r in table(spark, sf, "benchmark").collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, v in want.items() if not v[4]}


def test_personal_data(steps):
    before, after = steps["pii"]
    assert before.count() == after.count()
    assert not any(pii.base_spans(r.text or "") for r in after.collect())


def test_packing_covers_every_document(steps):
    before, after = steps["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.select("doc_id").distinct().collect()}


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
