"""All core queries by name, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL it is compared with, if SQL can say it."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def literal(spark: SparkSession, rows: str, alias: str) -> DataFrame:
    """A small table out of SQL value rows that both engines read."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS {alias}")


from weir.plans import crawl, geo, merge, ranking, search, searchlog, sources, state, text  # noqa: E402, F401  (they register their queries)
