"""The queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kneser_ney, license_scan, lm_scoring, minhash, mixing, packing, quality_rules, recompression, suffix_dedup, topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": kneser_ney.op2_quality_classifier,
    "op3_packing": packing.op3_packing,
    "op4_minhash": minhash.op4_minhash,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_recompression": recompression.op7_recompression,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_mixing": mixing.op10_mixing,
}

#: None where SQL cannot express the method; tests/llm compares those with brute force.
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op4_minhash": minhash.OP4_SQL,
    "op5_suffix_dedup": suffix_dedup.OP5_SQL,
    "op6_lm_scoring": lm_scoring.OP6_SQL,
    "op7_recompression": recompression.OP7_SQL,
    "op8_license_scan": license_scan.OP8_SQL,
    "op9_topk_search": topk_search.OP9_SQL,
}
