"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dupforge.llm import exact_dedup, language, line_dedup, packing, pii, quality, simhash, token_blocks, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": token_blocks.op1_bpe_round_trip,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_pii": pii.op3_pii,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_language": language.op8_language,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality.ORACLE,
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
    }
