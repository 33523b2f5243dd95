"""Registered queries and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the driver tables (or fixture
views derived from them) and returns a DataFrame.  The oracle for the same key
is ANSI SQL over the same tables; column names match one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from autokpi.plans import q_core, q_quality, q_analyses, q_rollups, q_discover, q_misc, q_sources  # noqa: F401
