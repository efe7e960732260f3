"""Contract queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from tessera.llm import (
    codebooks,
    decontaminate,
    embedding_dedup,
    kmeans,
    language_id,
    line_dedup,
    near_dedup,
    oracles,
    packing,
    pii,
    secrets,
    sharding,
    tokens,
    toxicity,
)
from tessera.llm.common import lean


def _lean(query: Callable) -> Callable:
    def run(spark, sf_dir):
        lean(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    own = {
        "op1_language_id": language_id.op1_language_id,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_packing": packing.op3_packing,
        "op4_sharding": sharding.op4_sharding,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_pii": pii.op10_pii,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_centroids": kmeans.op12_centroids,
        "op13_vector_codes": codebooks.op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _lean(query) for name, query in own.items()}


def oracle_sql() -> dict[str, str]:
    own = {
        "op2_decontamination": oracles.DECONTAMINATION,
        "op7_near_dedup": oracles.NEAR_DEDUP,
        "op11_line_dedup": oracles.LINE_DEDUP,
        "op12_centroids": oracles.CENTROIDS,
        "op13_vector_codes": oracles.CODEBOOKS,
    }
    return {name: sql.strip() for name, sql in own.items()}
