"""Star-schema tables seen as panel shapes, and the same shapes as SQL.

Money is held as whole cents so totals are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import two_level_median
from tidemark.operators.joins import asof_join
from tidemark.operators.ordered import group_median


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def cents(c: str) -> Column:
    """Whole cents of a dollar amount; stays inside generated code, unlike decimal rounding."""
    return F.floor(F.col(c) * 100 + 0.5)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price offers: (date, series, provider, kind, value, gpus, model, seq)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_returnflag").alias("series"),
        F.col("l_suppkey").alias("provider"),
        F.col("l_linestatus").alias("kind"),
        cents("l_extendedprice").cast("double").alias("value"),
        F.col("l_linenumber").alias("gpus"),
        F.col("l_partkey").alias("model"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


OFFERS = """offers AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS series, l_suppkey AS provider,
         l_linestatus AS kind, floor(l_extendedprice * 100 + 0.5) AS value, l_linenumber AS gpus,
         l_partkey AS model, l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem)"""


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider-median price per (date, series)."""
    return two_level_median(offers(spark, sf_dir), ["date", "series"], "provider", "value")


DAILY = """votes AS (
  SELECT date, series, provider, median(value) AS vote FROM offers GROUP BY ALL),
daily AS (
  SELECT date, series, median(vote) AS value, count(*) AS entity_count,
         min(vote) AS low, max(vote) AS high, sum(vote) / count(*) AS average
  FROM votes GROUP BY ALL)"""


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly median price per (series, member), a member being the supplier's nation."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("member"))
    rows = (
        offers(spark, sf_dir)
        .join(suppliers, F.col("provider") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("date", F.date_trunc("week", "date").cast("date"))
    )
    return group_median(rows, ["series", "member", "date"], "value", "value")


PANEL = """panel AS (
  SELECT series, n_name AS member, CAST(date_trunc('week', date) AS DATE) AS date, median(value) AS value
  FROM offers JOIN supplier ON provider = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL)"""


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer depth: (date, source, offers)."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("source"))
        .agg(F.count(F.lit(1)).alias("offers"))
    )


DEPTH = """depth AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS source, count(*) AS offers
  FROM orders GROUP BY ALL)"""


def daily_depth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth(spark, sf_dir).groupBy("date").agg(F.sum("offers").alias("offers"))


DEPTH_DAYS = "depth_days AS (SELECT date, CAST(sum(offers) AS BIGINT) AS offers FROM depth GROUP BY date)"


def _order_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    regions = table(spark, sf_dir, "region")
    model = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Others").otherwise(
        F.concat_ws("/", "r_name", "c_mktsegment")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("model", model)
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly volume: (date, model, tokens) with an undisclosed ``Others``."""
    return (
        _order_models(spark, sf_dir)
        .groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), "model")
        .agg(F.sum(cents("o_totalprice")).alias("tokens"))
    )


ORDER_MODELS = """order_models AS (
  SELECT orders.*, n_name, c_nationkey,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Others' ELSE r_name || '/' || c_mktsegment END AS model
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""
USAGE = (
    ORDER_MODELS
    + """,
usage AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, model,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS tokens
  FROM order_models GROUP BY ALL)"""
)


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points per model: (model, date, seq, price); pending orders state no price."""
    price = F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice") / 50000)
    return (
        _order_models(spark, sf_dir)
        .where("model <> 'Others'")
        .select(
            "model", F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("seq"), price.alias("price")
        )
    )


USAGE_LEDGER = """usage_ledger AS (
  SELECT model, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq,
         CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice) / 50000 END AS price
  FROM order_models WHERE model <> 'Others'),
ledger_days AS (
  SELECT model, date, price FROM (
    SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY seq DESC) AS rn FROM usage_ledger)
  WHERE rn = 1)"""


def priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly volume with the price governing each model that week."""
    return asof_join(usage(spark, sf_dir), usage_ledger(spark, sf_dir), ["model"], "date", ["price"], "seq")


PRICED = """priced AS (
  SELECT u.date, u.model, u.tokens, l.price
  FROM usage u ASOF LEFT JOIN ledger_days l ON u.model = l.model AND u.date >= l.date)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-point ledger: (model, date, seq, value)."""
    return offers(spark, sf_dir).select("model", "date", "seq", "value")


def priced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with a second price, (model, date, seq, value, output); points without tax state the first alone."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("model"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        cents("l_extendedprice").cast("double").alias("value"),
        F.expr("nullif(l_tax, 0)").alias("output"),
    )


PRICED_LEDGER = """priced_ledger AS (
  SELECT l_partkey AS model, CAST(l_shipdate AS DATE) AS date, l_orderkey * 8 + l_linenumber AS seq,
         floor(l_extendedprice * 100 + 0.5) AS value, nullif(l_tax, 0) AS output FROM lineitem)"""


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly totals per nation: (entity, fy, q, date, value)."""
    d = F.col("o_orderdate").cast("date")
    return (
        _order_models(spark, sf_dir)
        .groupBy(
            F.col("n_name").alias("entity"), F.year(d).alias("fy"), F.quarter(d).alias("q"),
            F.trunc(d, "quarter").alias("date"),
        )
        .agg(F.sum(cents("o_totalprice")).alias("value"))
    )


QUARTERLY = """quarterly AS (
  SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(quarter(o_orderdate) AS INTEGER) AS q,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS value
  FROM order_models GROUP BY ALL)"""


def strong_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters at or above the entity's own mean, which leaves gaps."""
    rows = quarterly(spark, sf_dir)
    means = rows.groupBy("entity").agg((F.sum("value") / F.count(F.lit(1))).alias("_mean"))
    return rows.join(means, "entity").where("value >= _mean").drop("_mean")


STRONG = """strong AS (
  SELECT q.* FROM quarterly q JOIN (
    SELECT entity, sum(value) / count(*) AS mean_value FROM quarterly GROUP BY entity) m USING (entity)
  WHERE value >= mean_value)"""


def snapshots(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Daily order counts and totals of one status, by priority: (date, source, orders, cents)."""
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == status)
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("source"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("cents"))
    )


def _snapshot_sql(name: str, status: str) -> str:
    return f"""{name} AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS source, count(*) AS orders,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
  FROM orders WHERE o_orderstatus = '{status}' GROUP BY ALL)"""


PREV = _snapshot_sql("prev", "F")
NEW = _snapshot_sql("fresh", "O")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User activity: (user_id, ts, date, event_type, value, seq)."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("date"),
        "event_type",
        cents("value").alias("value"),
        F.col("event_id").alias("seq"),
    )


ACTIVITY = """activity AS (
  SELECT user_id, ts, CAST(ts AS DATE) AS date, event_type,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS value, event_id AS seq FROM events)"""
