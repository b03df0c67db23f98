"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(Tables) -> DataFrame``; ``register`` records it
with the SQL text that computes the same rows in DuckDB over the driver's
tables. ``queries()`` exposes them as ``(spark, data_dir) -> DataFrame``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillpoint.sources.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(tables)`` under ``name`` with optional SQL."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return wrap


def _load_all() -> None:
    # importing the plan modules fills the registry
    from tillpoint.plans import (  # noqa: F401
        q_accounts, q_digital, q_functions, q_inventory, q_jobs, q_outputs,
        q_ranking, q_reference, q_sales, q_streaming,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    out = {}
    for name, fn in _QUERIES.items():
        out[name] = (lambda f: (lambda spark, data_dir: f(Tables(spark, data_dir))))(fn)
    return out


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
