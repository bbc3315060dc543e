"""Queries of this subpackage, and SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import collision_search, conversation_repair, hard_negatives, language_id, license_scan, lm_score, media, mixing, ngram_jaccard, packing, secret_scan, substring_dedup, topk
from .common import table


def _on(name: str, operator: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator(table(spark, sf_dir, name))


OPERATORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "op1_license_scan": ("documents", license_scan.op1_license_scan),
    "op2_secret_scan": ("documents", secret_scan.op2_secret_scan),
    "op3_ngram_jaccard": ("documents", ngram_jaccard.op3_ngram_jaccard),
    "op4_source_mix": ("documents", mixing.op4_source_mix),
    "op5_language_id": ("documents", language_id.op5_language_id),
    "op6_media": ("documents", media.op6_media),
    "op7_substring_dedup": ("documents", substring_dedup.op7_substring_dedup),
    "op8_exact_topk": ("embeddings", topk.op8_exact_topk),
    "op9_best_fit_packing": ("documents", packing.op9_best_fit_packing),
    "op10_lm_score": ("documents", lm_score.op10_lm_score),
    "op11_conversation_repair": ("conversations", conversation_repair.op11_conversation_repair),
    "op12_collision_search": ("embeddings", collision_search.op12_collision_search),
    "op13_hard_negatives": ("embeddings", hard_negatives.op13_hard_negatives),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_on, source, operator) for name, (source, operator) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": ngram_jaccard.OP3_SQL, "op4_source_mix": mixing.OP4_SQL, "op8_exact_topk": topk.OP8_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
