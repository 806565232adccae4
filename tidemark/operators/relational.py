"""Sorting, limits and set operations with the tie and null rules the reports rely on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def custom_rank(c: str, order: Sequence[str]) -> Column:
    """Position of a value in a fixed order; unlisted values sort last."""
    found = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c))
    return F.when(found > 0, found).otherwise(len(order) + 1)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Sorted report of the first ``k`` rows: each task keeps ``k`` before they meet."""
    return df.orderBy(*order).limit(k)


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def inline_values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal relation of configuration rows."""
    return spark.createDataFrame(list(rows), schema)


def with_ingestion_order(df: DataFrame, file_order: Column, position: Column, name: str = "seq") -> DataFrame:
    """Explicit sequence column from file order and position, so ties never rest on row order."""
    return df.withColumn(name, F.struct(file_order.alias("file"), position.alias("pos")))
