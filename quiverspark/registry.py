"""The table of registered queries of the graph engine and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiverspark.graph import Graph
from quiverspark.sources import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}



def registered(name: str, sql: str | None = None):
    """Register a function of a graph as a query; ``sql`` sees nodes, edges, owners, walk and the raw tables."""

    def put(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(fixture.graph(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {fixture.SQL.strip()}\n{sql.lstrip()}"
        return f

    return put
