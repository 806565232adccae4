"""Streams over landed files give what the batch operators give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.helpers import d, rows
from tidemark.operators import series as S
from tidemark.streaming import jobs as K


def _land(spark, tmp_path, batches, schema, name="in"):
    """One parquet folder per batch, read back as a stream one file at a time in order."""
    root = tmp_path / name
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema).coalesce(1)
        df.write.mode("append").parquet(str(root))
    return str(root)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_upsert_stream(spark, tmp_path):
    schema = "day date, k string, v int, seq int"
    batches = [
        [(d("2026-01-01"), "a", 1, 0), (d("2026-01-01"), "b", 2, 1), (d("2026-01-02"), "a", 3, 2)],
        [(d("2026-01-02"), "a", 30, 3), (d("2026-01-02"), "c", 4, 4), (d("2026-01-02"), "c", 5, 5)],
    ]
    out = str(tmp_path / "table")
    for i, batch in enumerate(batches):
        path = _land(spark, tmp_path, [batch], schema, "landing")
        K.stream_upsert(_stream(spark, path, schema), out, str(tmp_path / "cp"), ["k"], "day", "seq").awaitTermination(120)
    assert rows(spark.read.parquet(out), "day", "k", "v") == [
        (d("2026-01-01"), "a", 1), (d("2026-01-01"), "b", 2), (d("2026-01-02"), "a", 30), (d("2026-01-02"), "c", 5),
    ]


WEEK_SCHEMA = "ts timestamp, model string, tokens long"


def _weeks(rnd):
    start = dt.datetime(2026, 1, 5)
    return [[(start + dt.timedelta(days=7 * w + rnd.randint(0, 6), hours=rnd.randint(0, 20)), rnd.choice("ab"), rnd.randint(1, 9)) for _ in range(20)] for w in range(4)]


def test_complete_weeks_equal_batch(spark, tmp_path):
    batches = _weeks(random.Random(1))
    path = _land(spark, tmp_path, batches, WEEK_SCHEMA)
    _drain(K.complete_week_totals(_stream(spark, path, WEEK_SCHEMA), "ts", "tokens", ["model"], "8 days"), "weeks")
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("ts")).first()[0]
    batch = (
        stored.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "model")
        .agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("rows"))
        .where(F.date_add("week", 7) <= F.lit(newest - dt.timedelta(days=8)))
    )
    got = rows(spark.table("weeks"))
    assert got == rows(batch) and got
    assert max(r[0] for r in got) < newest.date() - dt.timedelta(days=7)


def test_rolling_window_is_ingested_once(spark, tmp_path):
    schema = "ts timestamp, gpu string, pct double"
    day = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(days=i)
    batches = [[(day(i), "H100", float(i)) for i in range(run, run + 7)] for run in range(4)]
    path = _land(spark, tmp_path, batches, schema)
    _drain(K.deduplicated_window(_stream(spark, path, schema), "ts", ["ts", "gpu"]), "window_rows")
    assert rows(spark.table("window_rows"), "ts", "pct") == [(day(i), float(i)) for i in range(10)]


def test_change_events_equal_batch(spark, tmp_path):
    rnd = random.Random(4)
    schema = "series string, day date, seq long, v double"
    batches, seq = [], 0
    for b in range(3):
        batch = []
        for i in range(30):
            seq += 1
            batch.append((rnd.choice("abc"), d("2026-01-01") + dt.timedelta(days=b * 3 + i // 10), seq, float(rnd.randint(1, 3))))
        batches.append(batch)
    out, state, cp = (str(tmp_path / n) for n in ("out", "state", "cp"))
    for batch in batches:
        path = _land(spark, tmp_path, [batch], schema)
        K.stream_change_events(_stream(spark, path, schema), out, state, cp, ["series"], "day", "seq", "v").awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    expected = S.change_events(spark.createDataFrame(sum(batches, []), schema), ["series"], "day", "seq", "v")
    assert rows(got, *expected.columns) == rows(expected)


def test_late_rows_do_not_repeat_events(spark, tmp_path):
    schema = "series string, day date, seq long, v double"
    out, state, cp = (str(tmp_path / n) for n in ("out", "state", "cp"))
    for batch in ([("a", d("2026-01-02"), 5, 1.0)], [("a", d("2026-01-01"), 9, 7.0), ("a", d("2026-01-02"), 5, 1.0), ("a", d("2026-01-03"), 1, 2.0)]):
        path = _land(spark, tmp_path, [batch], schema)
        K.stream_change_events(_stream(spark, path, schema), out, state, cp, ["series"], "day", "seq", "v").awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    assert rows(got, "day", "event_type", "value") == [(d("2026-01-02"), "initial_observation", 1.0), (d("2026-01-03"), "value_change", 2.0)]


def test_sessions_and_sliding_depth_equal_batch(spark, tmp_path):
    rnd = random.Random(2)
    start = dt.datetime(2026, 1, 1)
    schema = "ts timestamp, user string, v long"
    data = sorted((start + dt.timedelta(hours=rnd.randint(0, 24 * 40)), rnd.choice("ab"), rnd.randint(1, 5)) for _ in range(80))
    path = _land(spark, tmp_path, [data[:40], data[40:]], schema)
    stored = spark.read.parquet(path)
    newest = data[-1][0]
    _drain(K.gap_sessions(_stream(spark, path, schema), "ts", ["user"], "v", "1770 minutes", "2 days"), "sessions")
    batch = K.gap_sessions(stored, "ts", ["user"], "v", "1770 minutes").where(F.col("session_end") <= F.lit(newest - dt.timedelta(days=2)))
    assert rows(spark.table("sessions")) == rows(batch) and batch.count() > 0
    _drain(K.trailing_depth(_stream(spark, path, schema), "ts", "v", ["user"], "2 days"), "depth7")
    sliding = K.trailing_depth(stored, "ts", "v", ["user"]).where(F.date_add("date", 1) <= F.lit(newest - dt.timedelta(days=2)).cast("date"))
    assert rows(spark.table("depth7")) == rows(sliding) and sliding.count() > 0


def test_ntz_timestamps_become_instants(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-01 10:00:00' AS ts")
    assert df.select(K.event_time("ts").alias("t")).schema["t"].dataType.typeName() == "timestamp"


def test_late_rows_are_counted_over_all_batches_and_kept(spark, tmp_path):
    """More batches than the query remembers; every late row has its own key, so none are combined."""
    schema = "ts timestamp, model string, tokens long"
    start = dt.datetime(2026, 1, 5)
    batches = []
    for i in range(12):
        late = [(start - dt.timedelta(days=400 + j), f"late{i}-{j}", 1) for j in range(i % 3 + 1)]
        batches.append([(start + dt.timedelta(days=7 * i), "on time", 1)] + (late if i >= 2 else []))
    path = _land(spark, tmp_path, batches, schema)
    counts = K.LateCounts()
    spark.streams.addListener(counts)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        query = _drain(K.complete_week_totals(_stream(spark, path, schema), "ts", "tokens", ["model"]), "many_late")
        want = sum(i % 3 + 1 for i in range(2, 12))
        assert counts.of(query) == want > K.dropped_rows(query)
    finally:
        spark.streams.removeListener(counts)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    out, state, cp = (str(tmp_path / n) for n in ("late", "state", "cp"))
    K.stream_late_rows(_stream(spark, path, schema), "ts", out, state, cp, closes=F.window("ts", "7 days", startTime="4 days")["end"]).awaitTermination(120)
    kept = spark.read.parquet(out)
    assert kept.count() == want and kept.where("model = 'on time'").count() == 0
