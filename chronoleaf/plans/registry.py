"""Collects the queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoleaf.plans import bundles, files, graphs, intervals, items, language, records, retrieval, scores, summaries

MODULES = (intervals, scores, language, graphs, items, files, bundles, retrieval, summaries, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
