"""Batch runs of the operators that also serve streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import ACTIVITY, activity
from tidemark.catalog.registry import query, with_
from tidemark.streaming import jobs as K


@query(
    "gap_sessions", "K5",
    with_(ACTIVITY, """o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM activity WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, seq) AS sid FROM o)""",
          """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events, CAST(sum(value) AS BIGINT) AS total FROM s GROUP BY user_id, sid"""),
)
def gap_sessions(spark, sf):
    return K.gap_sessions(activity(spark, sf), "ts", ["user_id"], "value", "6 hours")


@query(
    "trailing_depth", "K6",
    with_(ACTIVITY, """days AS (SELECT event_type, CAST(date + CAST(k AS INTEGER) AS DATE) AS date, value FROM activity, LATERAL (SELECT unnest(generate_series(0, 6)) AS k))""",
          "SELECT event_type, date, CAST(sum(value) AS BIGINT) AS total, count(*) AS rows FROM days GROUP BY event_type, date"),
)
def trailing_depth(spark, sf):
    return K.trailing_depth(activity(spark, sf), "ts", "value", ["event_type"])


@query(
    "weekly_event_totals", "K2, B14",
    with_(ACTIVITY, """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, CAST(sum(value) AS BIGINT) AS total, count(*) AS rows FROM activity GROUP BY 1, 2"""),
)
def weekly_event_totals(spark, sf):
    return K.complete_week_totals(activity(spark, sf), "ts", "value", ["event_type"])


@query(
    "deduplicated_activity", "F6",
    with_(ACTIVITY, "SELECT DISTINCT user_id, event_type, date FROM activity"),
)
def deduplicated_activity(spark, sf):
    return activity(spark, sf).select("user_id", "event_type", "date").dropDuplicates()


@query("activity_by_hour", "D21", with_(ACTIVITY, "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM activity GROUP BY 1"))
def activity_by_hour(spark, sf):
    hours = activity(spark, sf).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.col("w.start").alias("hour"), "n")
