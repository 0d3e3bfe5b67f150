"""Every registered query with the SQL that states the same result from columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The modules below register their queries on import.
from testlog.plans import tap_queries  # noqa: E402,F401
from testlog.plans import report_queries  # noqa: E402,F401
from testlog.plans import line_queries, run_queries  # noqa: E402,F401
from testlog.plans import stream_queries  # noqa: E402,F401
