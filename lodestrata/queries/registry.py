"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries; ``sql`` holds the equivalent SQL of those that SQL can express at full size."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = build
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator form of :meth:`add`."""

        def wrap(build: Query) -> Query:
            self.add(name, build, sql)
            return build

        return wrap

    def include(self, other: Registry) -> None:
        for name, build in other.queries.items():
            self.add(name, build, other.sql.get(name))
