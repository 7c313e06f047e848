"""The registered queries: a Spark job on the given tables and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Job
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, run: Job, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query '{name}' is registered twice")
    QUERIES[name] = Query(run, sql)
