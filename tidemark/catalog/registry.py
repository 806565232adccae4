"""Named queries over the star-schema tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers ``fn(spark, sf_dir)`` under a name with the inventory ids it exercises."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_(*parts: str) -> str:
    """``WITH`` clause from CTE texts followed by the final select."""
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body
