"""Every query of the engine with its oracle SQL; modules of ``tapeflow.plans`` register here."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query under ``name``, with DuckDB SQL for its rows where SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


MODULES = ("book_queries", "window_queries", "feature_queries", "calendar_queries", "evaluation_queries", "kernel_queries", "script_queries", "input_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"tapeflow.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
