"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, lm, packing, quality, secrets, simhash, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_packing": packing.op5_packing,
    "op6_secrets": secrets.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_lm_scores": lm.op9_lm_scores,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLES: dict[str, str] = {"op1_url_filter": url_filter.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op3_quality": quality.ORACLE, "op6_secrets": secrets.oracle()}
