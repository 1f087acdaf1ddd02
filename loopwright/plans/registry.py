"""All queries over the fixture tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("q_retrieval", "q_signals", "q_rules", "q_graph", "q_reports", "q_context", "q_sources")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for family in FAMILIES:
        found |= import_module(f"loopwright.plans.{family}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}
