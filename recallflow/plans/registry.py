"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query function, with its DuckDB text where one exists."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # All calendar arithmetic is defined in UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module once and return both tables."""
    import importlib
    import pkgutil

    import recallflow.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"recallflow.plans.{module.name}")
    return dict(QUERIES), dict(ORACLES)
