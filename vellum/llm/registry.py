"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name: module of this subpackage
QUERIES = {
    "op1_toxicity": "toxicity",
    "op2_lm_score": "lm_score",
    "op3_merkle_fingerprint": "merkle",
    "op4_mixing": "mixing",
    "op5_simhash_dedup": "simhash",
    "op6_warc": "warc",
    "op7_decontaminate": "decontaminate",
    "op8_pii": "pii",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_hilbert_shards": "hilbert",
    "op11_filter_audit": "filter_audit",
    "op12_ranked_search": "impact_index",
    "op13_secret_scan": "secret_scan",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"vellum.llm.{module}").query for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"vellum.llm.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
