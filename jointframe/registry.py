"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from jointframe.session import Tables


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(rows: str, sql: str | None = None):
    """Register a builder; ``rows`` names the survey rows it covers."""

    def add(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, rows, build, sql)
        return build

    return add
