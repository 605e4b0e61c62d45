"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import compression, decontamination, jaccard_join, language_model, mixing, pii, quality_rules, resampling, sharding, spelling, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        quality_rules.op1_boosted_quality_rules,
        jaccard_join.op2_minhash_forest_join,
        decontamination.op3_cgk_decontamination,
        sharding.op4_vector_bin_packing,
        token_counts.op5_delta_token_rollup,
        language_model.op6_log_bilinear_scores,
        pii.op7_weak_supervision_pii,
        compression.op8_compression_classifier,
        suffix_dedup.op9_sparse_suffix_spans,
        mixing.op10_sainte_lague_mix,
        resampling.op11_crc_importance_resampling,
        toxicity.op12_noisy_channel_toxicity,
        spelling.op13_partenum_spelling_variants,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op5_delta_token_rollup": token_counts.ORACLE, "op11_crc_importance_resampling": resampling.ORACLE, "op13_partenum_spelling_variants": spelling.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
