"""Query registry of the engine's own operators: each name has a frame over the driver's tables and, mostly, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bomlens.plans.domain import Domain

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Domain under a name."""

    def register(function):
        _QUERIES[name] = lambda spark, sf_dir: function(Domain(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def _load() -> None:
    from bomlens.plans import queries_aggregate, queries_ingest, queries_join, queries_scalar, queries_search  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch profile counts, unique and weighted by components."""
    _load()
    return _QUERIES["E16_mismatch_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
