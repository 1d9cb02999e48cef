"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapter_queries, candidate_queries, frame_queries, geometry_queries, label_queries, rank_queries, score_queries, service_queries, vector_queries

_ALL = rank_queries.QUERIES | vector_queries.QUERIES | score_queries.QUERIES | geometry_queries.QUERIES | adapter_queries.QUERIES | service_queries.QUERIES | label_queries.QUERIES | candidate_queries.QUERIES | frame_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
