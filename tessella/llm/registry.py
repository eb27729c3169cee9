"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, exact_dedup, lm_scoring, mixing, ngram_join, pii, secrets_scan, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_topk": topk.query,
    "op2_pii": pii.query,
    "op3_bpe": bpe.query,
    "op4_mixing": mixing.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_ngram_join": ngram_join.query,
    "op7_warc": warc.query,
    "op8_toxicity": toxicity.query,
    "op9_lm_scoring": lm_scoring.query,
    "op10_secrets": secrets_scan.query,
}

SQL: dict[str, str] = {
    "op1_topk": topk.SQL,
    "op4_mixing": mixing.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_warc": warc.SQL,
}
