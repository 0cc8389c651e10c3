"""Registry of named queries, each with an optional SQL text for the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query]
    oracles: dict[str, str]

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add


def new() -> Registry:
    return Registry({}, {})
