"""The engine's registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Add one query; a second one of the same name is an error."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def _load() -> None:
    """Imports the modules that register queries."""
    from quarrylane.plans import aggregates, execution, relational, review, roundtrip, runs, schema, text, validation  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the engine."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The oracle SQL of the queries that have one."""
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that ``entry`` runs."""
    from quarrylane.plans import execution

    return execution.flagship(spark, sf_dir)
