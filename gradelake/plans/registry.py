"""Registered queries: a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradelake.plans.fixtures import Tables, with_ctes


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def _load() -> None:
    from gradelake.plans import queries_catalog, queries_cells, queries_grading, queries_layout  # noqa: F401
    from gradelake.plans import queries_hard, queries_parse, queries_quality, queries_sources, queries_streams  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(q: Query):
        return lambda spark, folder: q.build(Tables(spark, folder))

    return {name: bind(q) for name, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    return {name: with_ctes(q.sql) for name, q in REGISTRY.items() if q.sql}
