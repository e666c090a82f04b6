"""Named queries over the driver tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def day(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("date").cast("string").alias(name or c)


from mnemora.plans import graph_queries, ingest_queries, source_queries, store_queries, stream_queries  # noqa: E402, F401
