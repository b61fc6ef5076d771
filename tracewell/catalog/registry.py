"""Query registry: one Spark callable and, where SQL can say it, one oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def call(spark: SparkSession, folder: str) -> DataFrame:
            return run(prepare(spark), folder)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
