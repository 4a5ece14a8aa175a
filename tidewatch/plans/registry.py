"""Named queries over the shared tables, each with the SQL another engine checks it by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return register


def load_all() -> dict[str, Query]:
    from tidewatch.plans import audit, decisions, drift, models, preparation, quality, stores, streams  # noqa: F401

    return QUERIES
