"""One table of queries: name -> (function, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries with their DuckDB counterpart."""

    def __init__(self) -> None:
        self._queries: dict[str, QueryFn] = {}
        self._sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        """Decorator: register ``fn`` as ``name``; ``sql`` is what DuckDB runs over the same tables."""

        def put(fn: QueryFn) -> QueryFn:
            if name in self._queries:
                raise ValueError(f"query {name} is registered twice")
            self._queries[name] = fn
            if sql is not None:
                self._sql[name] = sql
            return fn

        return put

    def include(self, other: Registry) -> None:
        """Takes over all of ``other``'s queries."""
        for name, fn in other.queries().items():
            self.query(name, other.sql().get(name))(fn)

    def queries(self) -> dict[str, QueryFn]:
        return dict(self._queries)

    def sql(self) -> dict[str, str]:
        return dict(self._sql)
