"""Collects the runnable queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with the SQL that must agree with it."""
        def keep(function: Query) -> Query:
            name = function.__name__
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function
        return keep


REGISTRY = Registry()
