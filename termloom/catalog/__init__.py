"""Named queries over the test tables, each with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_AREAS = ("records", "retrieval", "answers", "reports", "streams")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for area in _AREAS for name, fn in import_module(f"{__name__}.{area}").QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in import_module(f"{__name__}.{area}").ORACLES.items()}
