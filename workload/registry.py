"""Registration of a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """``sql`` reads the tables directly; queries without it are tested against brute force on a fixture."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def graph_query(name: str, sql: str | None):
    """Register a function of the projected graph; ``sql`` follows the graph's table expressions."""
    head = "" if sql is None else star.graph_sql(sql)
    if sql is not None and sql.startswith(",") and not head:
        sql = f"WITH {sql[1:]}"
    full = None if sql is None else f"{head}{sql}" if sql.startswith(",") else f"{head} {sql}"

    def add(function: Callable[..., DataFrame]):
        register(name, full)(lambda spark, folder: function(star.graph(spark, folder)))
        return function
    return add
