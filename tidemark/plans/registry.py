"""Queries of the audit engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import base, q_audit, q_more, q_policy, q_sources, q_stream


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one sweep: the stream's expectation against the store."""
    return base.findings(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    assert q_audit and q_more and q_policy and q_sources and q_stream  # their import registers the queries
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
