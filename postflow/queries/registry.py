"""Registration of queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postflow.sources import bindings

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """The queries of one module."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.ORACLE: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query. The SQL may use the bindings' tables; they come before it as common table expressions."""

        def put(f: Query) -> Query:
            self.QUERIES[name] = f
            if sql is not None:
                self.ORACLE[name] = f"WITH {bindings.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
            return f

        return put
