"""Registers queries under their function names, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: adds the function as a query, and ``sql`` as its oracle if given."""

        def add(f: Query) -> Query:
            name = f.__name__
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
