"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import classify, hamming, licenses, lm_scoring, mixing, near_dedup, negatives, packing, repair, sharding, tiff, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": classify.op3_toxicity,
    "op4_quality_classifier": classify.op4_quality_classifier,
    "op5_media_tiff": tiff.op5_media_tiff,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_top_k_search": hamming.op8_top_k_search,
    "op9_sharding": sharding.op9_sharding,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_url_filters": urls.op11_url_filters,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op8_top_k_search": hamming.OP8_SQL, "op12_conversation_repair": repair.OP12_SQL, "op13_hard_negatives": negatives.OP13_SQL}
