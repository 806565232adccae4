"""Structured Streaming forms of the accumulation operators."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.merge import last_wins
from tidemark.operators.ordered import last_per_key, null_safe_join
from tidemark.operators.series import change_events


def event_time(c: str) -> Column:
    """Zone-less timestamps as UTC instants; watermarks accept only those."""
    return F.col(c).cast("timestamp")


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str, seq: str
) -> StreamingQuery:
    """Keyed upsert of arriving snapshots into a partitioned table; per key the greatest ``seq`` stays.

    A batch reads and replaces only the partitions it touches, named as literals so that no other folder is
    listed: their stored rows and the batch's are reduced to the last row per key by ``seq``, which lets an
    older row that comes late lose. One dynamic overwrite commits them, so replaying a batch changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = last_wins(batch, [*keys, partition], seq)
        touched = [r[0] for r in batch.select(partition).distinct().collect()]  # partitions of one batch
        try:
            merged = last_wins(touched_rows(spark, path, batch.schema, partition, touched).unionByName(fresh), [*keys, partition], seq)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            merged = fresh
        (
            merged.select(*batch.columns)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(path)
        )

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def touched_rows(spark: SparkSession, path: str, schema: StructType, partition: str, touched: Sequence) -> DataFrame:
    """Stored rows of the named partitions; the filter is on literals and prunes folders when planned."""
    stored = spark.read.schema(schema).parquet(path)
    known = [x for x in touched if x is not None]
    wanted = F.col(partition).isin(known)
    return stored.where(wanted | F.col(partition).isNull() if len(known) < len(touched) else wanted)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark in the batches the query still remembers; :class:`LateCounts` counts all."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


class LateCounts(StreamingQueryListener):
    """Adds up what stateful operators drop behind the watermark, over all batches of every query of a session.

    ``recentProgress`` forgets old batches, this does not. Aggregations combine equal keys before they look at
    the watermark, so the count is of their rows; :func:`stream_late_rows` keeps the rows themselves.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        self.ended[str(event.runId)].clear()

    def onQueryProgress(self, event) -> None:
        self.dropped[str(event.progress.runId)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def of(self, query: StreamingQuery, wait: float = 60) -> int:
        """The count of a run; of one that ended, after its last event has come."""
        if not query.isActive and not self.ended[str(query.runId)].wait(wait):
            raise TimeoutError("the end of the query was not announced")
        return self.dropped[str(query.runId)]


def stream_late_rows(
    stream: DataFrame, ts: str, out: str, state: str, checkpoint: str, lateness: str = "1 day", closes: Column | None = None
) -> StreamingQuery:
    """Writes the rows that a stateful operator with this watermark drops, a folder per batch.

    A row is late if ``closes`` (its time; for windows, their end) is not after the watermark of the batch
    before, which is the newest time of all batches before that one less ``lateness``. The newest time of each
    batch is one row in the shared folder ``state``, so a replayed batch finds what it found.
    """
    ends = F.col(ts) if closes is None else closes

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "epoch long, newest timestamp"
        # A batch is judged by those before the one before it.
        try:
            seen = spark.read.schema(schema).parquet(state).where(F.col("epoch") < epoch - 1).agg(F.max("newest")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            seen = None
        if seen is not None:
            late = batch.where(ends <= F.lit(seen) - F.expr(f"INTERVAL {lateness}"))
            late.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        newest = batch.agg(F.max(ts).cast("timestamp").alias("newest")).selectExpr(f"{epoch}L AS epoch", "newest")
        newest.where("newest IS NOT NULL").write.mode("append").parquet(state)

    timed = stream.withColumn(ts, event_time(ts))
    return timed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_week_totals(
    stream: DataFrame, ts: str, value: str, by: Sequence[str] = (), lateness: str = "1 day"
) -> DataFrame:
    """Weekly totals from Mondays, emitted once the watermark has passed the week's end.

    Later rows are dropped; :class:`LateCounts` counts them, :func:`stream_late_rows` keeps them.
    """
    weeks = F.window(ts, "7 days", startTime="4 days")
    return (
        stream.withColumn(ts, event_time(ts))
        .withWatermark(ts, lateness)
        .groupBy(weeks.alias("_w"), *by)
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("_w.start").cast("date").alias("week"), *by, "total", "rows")
    )


def deduplicated_window(stream: DataFrame, ts: str, keys: Sequence[str], lateness: str = "8 days") -> DataFrame:
    """Each key once although the source repeats a rolling seven-day window in every snapshot.

    Rows beyond the watermark are dropped; :class:`LateCounts` counts them, :func:`stream_late_rows` keeps them.
    """
    return (
        stream.withColumn(ts, event_time(ts)).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))
    )


STATE_BUCKETS = 64


def stream_change_events(
    stream: DataFrame, out: str, state: str, checkpoint: str, keys: Sequence[str], t: str, seq: str, value: str,
    late: str | None = None, buckets: int = STATE_BUCKETS,
) -> StreamingQuery:
    """First observations and true value changes per key as they arrive.

    The state, one last row per key, lies in hash buckets under the shared folder ``state``. A batch reads and
    writes only the buckets of its keys, runs the batch operator, which splits busy keys over tasks, and leaves
    per bucket its own version and the one before, so a replayed batch starts from what it started from. Rows
    older than their key's state go to ``late``, a folder per batch, if it is given.
    """
    columns = [*keys, t, seq, value]

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.select(*columns).where(F.col(value).isNotNull()).withColumn("_bucket", bucket)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        schema = StructType([*rows.schema.fields, StructField("_epoch", LongType())])
        try:
            stored = touched_rows(spark, state, schema, "_bucket", touched).where(F.col("_epoch") < epoch)
            versions = stored.groupBy("_bucket").agg(F.max("_epoch").alias("_epoch")).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored, versions = None, []
        if versions:
            current = [(F.col("_bucket") == v["_bucket"]) & (F.col("_epoch") == v["_epoch"]) for v in versions]
            previous = stored.where(reduce(lambda a, b: a | b, current)).select(*columns)
        else:
            previous = rows.limit(0).select(*columns)
        bounds = previous.select(*keys, F.col(t).alias("_t"), F.col(seq).alias("_s"))
        is_late = F.col("_t").isNotNull() & (F.struct(t, seq) <= F.struct("_t", "_s"))
        placed = null_safe_join(rows.select(*columns), bounds, keys, "left")
        fresh = placed.where(~is_late).select(*columns)
        if late is not None:
            placed.where(is_late).select(*columns).write.mode("overwrite").parquet(f"{late}/epoch={epoch}")
        active = previous.join(fresh.select(*keys).distinct(), list(keys), "left_semi")
        events = change_events(active.unionByName(fresh), keys, t, seq, value)
        known = active.select(*keys, t, seq)
        events.join(known, [*keys, t, seq], "left_anti").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        last = last_per_key(previous.unionByName(fresh), keys, [t, seq]).select(*columns)
        last = last.withColumn("_bucket", bucket).withColumn("_epoch", F.lit(epoch).cast("long"))
        (
            last.repartition("_bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_bucket", "_epoch")
            .parquet(state)
        )
        _drop_versions(spark, state, touched, {v["_bucket"]: v["_epoch"] for v in versions})

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _drop_versions(spark: SparkSession, state: str, touched: Sequence[int], kept: dict[int, int]) -> None:
    """Removes versions of the touched buckets that are older than the one the batch started from."""
    jvm = spark.sparkContext._jvm
    for bucket in touched:
        folder = jvm.org.apache.hadoop.fs.Path(f"{state}/_bucket={bucket}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            name = status.getPath().getName()
            if name.startswith("_epoch=") and int(name.removeprefix("_epoch=")) < kept.get(bucket, -1):
                fs.delete(status.getPath(), True)


def gap_sessions(
    df: DataFrame, ts: str, keys: Sequence[str], value: str, gap: str, lateness: str | None = None
) -> DataFrame:
    """Sessions split by a gap; the same call serves batch and stream.

    Bounds come from the session's own events: a filter on the grouping window would be pushed below
    the merge of sessions and cut them.
    """
    timed = df.withColumn(ts, event_time(ts))
    if lateness is not None:
        timed = timed.withWatermark(ts, lateness)
    return (
        timed.groupBy(*keys, F.session_window(ts, gap).alias("_s"))
        .agg(
            F.min(ts).alias("session_start"),
            (F.max(ts) + F.expr(f"INTERVAL {gap}")).alias("session_end"),
            F.count(F.lit(1)).alias("events"),
            F.sum(value).alias("total"),
        )
        .drop("_s")
    )


def trailing_depth(
    df: DataFrame, ts: str, value: str, by: Sequence[str] = (), lateness: str | None = None
) -> DataFrame:
    """Seven-day total ending each day; the same call serves batch and stream."""
    timed = df.withColumn(ts, event_time(ts))
    if lateness is not None:
        timed = timed.withWatermark(ts, lateness)
    span = F.window(ts, "7 days", "1 day")
    return (
        timed.groupBy(*by, span.alias("_w"))
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
        .select(*by, F.date_sub(F.col("_w.end").cast("date"), 1).alias("date"), "total", "rows")
    )
