"""The queries that the library registers, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stillwave.plans import bindings, event_queries, inventory_queries, kernel_queries, quality_queries, report_queries, signal_queries, source_queries, window_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (window_queries, inventory_queries, quality_queries, signal_queries, event_queries, kernel_queries, source_queries, report_queries):
    QUERIES |= _module.PLANS.queries
    ORACLES |= _module.PLANS.oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily chunk statistics by event type with quality verdicts."""
    return QUERIES["qcv1_qcone"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "bindings", "flagship"]
