"""Name → (query, oracle SQL): what the driver contract runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"registered twice: {name}")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def load() -> None:
    """Import the modules that register queries."""
    from .plans import relational, reports, retrieval, structure, texts  # noqa: F401
