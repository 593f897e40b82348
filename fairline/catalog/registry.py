"""Registry of runnable queries: name -> (Spark callable, optional DuckDB oracle text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import oracle

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def add(runner: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = runner
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return runner

    return add
