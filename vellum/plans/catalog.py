"""All queries of the library outside the training-data subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import bounds_queries, candidate_queries, closure_queries, consensus_queries, evidence_queries, gap_queries, ink_queries, layout_queries, number_queries, page_queries, residual_queries, semantic_queries, sql_queries, text_queries, trace_queries

MODULES = (text_queries, number_queries, layout_queries, page_queries, semantic_queries, trace_queries, residual_queries, closure_queries, candidate_queries, consensus_queries, evidence_queries, sql_queries, gap_queries, bounds_queries, ink_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
