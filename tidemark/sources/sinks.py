"""Partitioned writes of facts and state reports.

``write_fact`` and ``write_state`` replace partitions in place. ``publish`` never touches what readers see: new
files go to a folder of their own, and one small file then says which folder each partition is read from.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_fact(df: DataFrame, path: str, by: str = "date", files_per_partition: int | None = None) -> None:
    """Replaces exactly the partitions present in ``df``; the commit makes them visible at once.

    ``files_per_partition`` salts the partition value so one large day is written by several tasks;
    the salt is a hash of the row, so a retried task places its rows as before.
    """
    out = df
    if files_per_partition:
        plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
        out = df.repartition(by, F.pmod(F.xxhash64(*plain), F.lit(files_per_partition)))
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def write_state(clocks: DataFrame, path: str) -> None:
    """State report per day under ``history/as_of=...`` and the newest one under ``latest``.

    The report is computed once, into the history, and ``latest`` is a copy of its newest day. The copy is one
    partition, replaced as a whole when its job commits, so a reader never finds the folder empty.
    """
    spark = clocks.sparkSession
    clocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").json(f"{path}/history")
    history = spark.read.schema(clocks.schema).json(f"{path}/history")
    newest = history.agg(F.max("as_of")).scalar()
    copy = history.where(F.col("as_of") == newest).withColumn("slot", F.lit("newest"))
    copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").json(f"{path}/latest")


POINTER = "version long, writer string, partition string, folder string"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of the newest complete version and their folders; empty before the first one."""
    try:
        pointers = spark.read.schema(POINTER).parquet(f"{path}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)
    newest = pointers.agg(F.max(F.struct("version", "writer")).alias("_n")).first()._n
    return pointers.where((F.col("version") == newest.version) & (F.col("writer") == newest.writer)) if newest else pointers.limit(0)


def publish(df: DataFrame, path: str, by: str = "date") -> int:
    """Replaces the partitions present in ``df`` for all readers at one moment; returns the new version.

    The rows are written to a folder that no version names yet. A single file with one row per partition, as
    many as days, then appears as the newest version: a write that is killed before leaves the old version
    whole, one killed after has happened. Of writers that meet, one wins whole; older versions stay readable.
    """
    spark = df.sparkSession
    writer = uuid.uuid4().hex
    folder = f"data/{writer}"
    df.withColumn("_part", F.coalesce(F.col(by).cast("string"), F.lit(""))).write.partitionBy("_part").parquet(f"{path}/{folder}")
    fresh = spark.read.schema("_part string").parquet(f"{path}/{folder}").select(F.col("_part").alias("partition")).distinct()
    old = published(spark, path)
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    own = (f"{version}L AS version", f"'{writer}' AS writer")
    rows = fresh.selectExpr(*own, "coalesce(partition, '') AS partition", f"'{folder}' AS folder")
    kept = old.join(rows.select("partition"), "partition", "left_anti").selectExpr(*own, "partition", "folder")
    rows.unionByName(kept).coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return version


def read_published(spark: SparkSession, path: str, schema: str, only: list | None = None) -> DataFrame:
    """The rows of the newest version, or of some of its partitions; ``schema`` names their columns."""
    named = published(spark, path)
    if only is not None:
        named = named.where(F.col("partition").isin(["" if p is None else str(p) for p in only]))
    parts = [f"{path}/{r.folder}/_part={r.partition or '__HIVE_DEFAULT_PARTITION__'}" for r in named.collect()]  # one per partition
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
