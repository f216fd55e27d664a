"""All registered queries of the reference's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Inventory ids that each query covers.
IDS: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        IDS[fn.__name__] = ids
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import analysis, decisions, graphs, ranking, relational, summaries  # noqa: F401


load()
