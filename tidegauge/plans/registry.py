"""All queries of the recording-quality engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_alignment, queries_cameras, queries_cohort, queries_gates, queries_metrics, queries_scoring, queries_vision

_MODULES = (queries_metrics, queries_scoring, queries_alignment, queries_cohort, queries_vision, queries_gates, queries_cameras)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
