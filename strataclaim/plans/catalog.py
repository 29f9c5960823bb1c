"""The catalogue of named queries: each with a DataFrame plan and, where SQL can say it, its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "drift_state"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a plan under its function's name, with the SQL it must agree with."""

    def add(fn):
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = fn
        if sql:
            _SQL[key] = sql
        return fn

    return add


MODULES = ("textplans", "driftplans", "storeplans", "aggplans", "joinplans", "graphplans", "streamplans", "hookplans", "researchplans", "claimplans", "ladderplans")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"strataclaim.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
