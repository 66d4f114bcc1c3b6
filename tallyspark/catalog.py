"""All ledger queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import civic, comparing, graphs, ledger, movement, ordered, papers, prices, printed, relations, site, succession, textual, trends, vetoes

_MODULES = [ledger, prices, trends, movement, textual, succession, graphs, papers, site, civic, comparing, vetoes, printed, relations, ordered]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
