"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slickwake.llm import chunk_dedup, decontaminate, exact_dedup, line_dedup, manifest, mixing, ngram_quality, pii, resampling, simhash, suffix_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        warc.op1_warc_capture_index,
        pii.op2_bootstrapped_pii,
        exact_dedup.op3_patricia_exact_dedup,
        mixing.op5_capped_water_filling,
        suffix_dedup.op4_bucket_pointer_dedup,
        line_dedup.op6_segment_partition_line_dedup,
        simhash.op7_simhash_near_duplicates,
        chunk_dedup.op8_content_defined_chunk_dedup,
        ngram_quality.op9_kneser_ney_quality,
        decontaminate.op10_prefix_filtered_decontamination,
        resampling.op11_importance_resampling,
        toxicity.op12_nearest_toxicity,
        manifest.op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_capture_index": warc.OP1_SQL,
        "op3_patricia_exact_dedup": exact_dedup.OP3_SQL,
        "op4_bucket_pointer_dedup": suffix_dedup.OP4_SQL,
        "op5_capped_water_filling": mixing.OP5_SQL,
        "op6_segment_partition_line_dedup": line_dedup.OP6_SQL,
        "op10_prefix_filtered_decontamination": decontaminate.OP10_SQL,
        "op11_importance_resampling": resampling.OP11_SQL,
        "op13_merkle_manifest": manifest.OP13_SQL,
    }
