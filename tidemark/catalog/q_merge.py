"""Merge, deduplication, sorting and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import (
    DEPTH, NEW, OFFERS, PREV, USAGE, activity, ACTIVITY, day, depth, ledger, offers, snapshots, table, usage,
)
from tidemark.catalog.registry import query, with_
from tidemark.operators import merge as M
from tidemark.operators import relational as R

AS_OF = "2001-07-01"
START = "1997-01-06"


@query(
    "merge_replace_day", "F1",
    with_(PREV, NEW, """SELECT * FROM prev WHERE date <> DATE '1998-06-01' UNION ALL SELECT * FROM fresh WHERE date = DATE '1998-06-01'"""),
)
def merge_replace_day(spark, sf):
    fresh = snapshots(spark, sf, "O").where(F.col("date") == day("1998-06-01"))
    return M.merge_replace_day(snapshots(spark, sf, "F"), fresh, "date", day("1998-06-01"))


UPSERT = "SELECT * FROM prev p WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.date = p.date AND f.source = p.source) UNION ALL SELECT * FROM fresh"


@query("merge_upsert", "F2", with_(PREV, NEW, UPSERT))
def merge_upsert(spark, sf):
    return M.merge_upsert(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), ["date", "source"])


def _stated(spark, sf, status):
    rows = snapshots(spark, sf, status)
    return rows.withColumn("_present", F.when(F.col("orders") > 1, F.array(F.lit("orders"), F.lit("cents"))).otherwise(F.array(F.lit("orders"))))


@query(
    "merge_fields", "F3",
    with_(PREV, NEW, """SELECT date, source, CASE WHEN f.orders IS NOT NULL THEN f.orders ELSE p.orders END AS orders,
  CASE WHEN f.orders > 1 THEN f.cents WHEN f.orders = 1 THEN NULL ELSE p.cents END AS cents,
  CASE WHEN f.orders > 1 OR (f.orders IS NULL AND p.orders > 0) THEN 'cents,orders' ELSE 'orders' END AS stated
FROM prev p FULL JOIN fresh f USING (date, source)"""),
)
def merge_fields(spark, sf):
    prev = snapshots(spark, sf, "F").withColumn("_present", F.array(F.lit("orders"), F.lit("cents")))
    out = M.merge_fields(prev, _stated(spark, sf, "O"), ["date", "source"], ["orders", "cents"], clears={"orders": ["cents"]})
    return out.withColumn("stated", F.array_join("_present", ",")).drop("_present")


@query(
    "merge_retain_complete", "F4, B14",
    with_(PREV, NEW, f"""SELECT * FROM ({UPSERT}) WHERE date >= DATE '{START}' AND date + 6 < DATE '{AS_OF}'"""),
)
def merge_retain_complete(spark, sf):
    return M.merge_retain_complete(
        snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), ["date", "source"], "date", day(START), day(AS_OF)
    )


@query(
    "merge_group_replace", "F5",
    with_(PREV, NEW, USAGE, """SELECT * FROM (SELECT * FROM prev WHERE date NOT IN (SELECT date FROM fresh) UNION ALL SELECT * FROM fresh)
WHERE date IN (SELECT date FROM usage)"""),
)
def merge_group_replace(spark, sf):
    return M.merge_group_replace(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), "date", usage(spark, sf))


@query(
    "first_wins", "F6",
    with_(OFFERS, "SELECT model, provider, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY model, provider ORDER BY seq) AS rn FROM offers) WHERE rn = 1"),
)
def first_wins(spark, sf):
    rows = offers(spark, sf).select("model", "provider", "seq", "value")
    return M.first_wins(rows, ["model", "provider"], "seq")


@query(
    "last_wins", "F6",
    with_(ACTIVITY, "SELECT user_id, event_type, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq DESC) AS rn FROM activity) WHERE rn = 1"),
)
def last_wins(spark, sf):
    rows = activity(spark, sf).select("user_id", "event_type", "seq", "value")
    return M.last_wins(rows, ["user_id", "event_type"], "seq")


@query(
    "capex_key_dedupe", "F7",
    """SELECT date, company, metric, period, value FROM (
  SELECT *, row_number() OVER (PARTITION BY date, company, metric ORDER BY seq DESC) AS rn FROM (
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS company, 'capex actual' AS metric,
           'FY' || year(o_orderdate) || CASE WHEN o_orderstatus = 'O' THEN ' 累计（约6个月）' ELSE '' END AS period,
           o_totalprice AS value, o_orderkey AS seq FROM orders)) WHERE rn = 1""",
)
def capex_key_dedupe(spark, sf):
    suffix = F.when(F.col("o_orderstatus") == "O", " 累计（约6个月）").otherwise("")
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("company"),
        F.lit("capex actual").alias("metric"),
        F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), suffix).alias("period"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("seq"),
    )
    return M.capex_key_dedupe(rows, "date", "company", "metric", "period", "seq").drop("seq")


@query(
    "carry_forward", "F8",
    with_(PREV, NEW, """SELECT date, orders, origin FROM (
  SELECT date, CAST(sum(orders) AS BIGINT) AS orders, CASE WHEN day(date) = 1 THEN 'first_run' ELSE 'prev_run' END AS origin FROM prev
  WHERE date NOT IN (SELECT date FROM fresh) GROUP BY date
  UNION ALL SELECT date, CAST(sum(orders) AS BIGINT), NULL FROM fresh GROUP BY date)"""),
)
def carry_forward(spark, sf):
    prev = snapshots(spark, sf, "F").groupBy("date").agg(F.sum("orders").alias("orders"))
    prev = prev.withColumn("origin", F.when(F.dayofmonth("date") == 1, "first_run"))
    fresh = snapshots(spark, sf, "O").groupBy("date").agg(F.sum("orders").alias("orders"))
    fresh = fresh.withColumn("origin", F.lit(None).cast("string"))
    return M.carry_forward(prev, fresh, "date", "origin", F.lit("prev_run"))


@query(
    "merge_provenance", "F9, C11",
    with_(PREV, NEW, f"""o AS (SELECT DISTINCT date, true AS was FROM prev WHERE date >= DATE '{START}' AND date + 6 < DATE '{AS_OF}'),
n AS (SELECT DISTINCT date, true AS now FROM fresh WHERE date >= DATE '{START}' AND date + 6 < DATE '{AS_OF}'),
j AS (SELECT * FROM o FULL JOIN n USING (date))""",
          """SELECT count(was) AS prior_periods, count(now) AS upstream_periods, count(*) AS retained_periods,
  count(*) FILTER (WHERE now IS NULL) AS local_only_periods, count(now) AS overwritten_periods,
  min(date) FILTER (WHERE now IS NULL) AS first_local_only FROM j"""),
)
def merge_provenance(spark, sf):
    return M.merge_provenance(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), "date", day(START), day(AS_OF))


@query(
    "canonicalize", "F10",
    """SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem""",
)
def canonicalize(spark, sf):
    return M.canonicalize(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query(
    "analysis_view", "F10",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0",
)
def analysis_view(spark, sf):
    eligible = (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 0)
    return M.analysis_view(table(spark, sf, "orders"), eligible).select("o_orderkey", "o_totalprice")


@query(
    "latest_status", "F11",
    with_(ACTIVITY, "SELECT user_id, event_type, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM activity) WHERE rn = 1"),
)
def latest_status(spark, sf):
    return M.latest_status(activity(spark, sf), "user_id", ["ts", "seq"]).select("user_id", "event_type", "value", "seq")


@query(
    "upsert_by_business_key", "F12",
    """WITH runs AS (SELECT CAST(c_nationkey AS VARCHAR) AS run_id, count(*) AS n FROM customer GROUP BY 1),
fresh AS (SELECT CAST(s_nationkey AS VARCHAR) AS run_id, count(*) AS n FROM supplier GROUP BY 1)
SELECT * FROM runs WHERE run_id NOT IN (SELECT run_id FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def upsert_by_business_key(spark, sf):
    count = F.count(F.lit(1)).alias("n")
    prev = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("run_id")).agg(count)
    fresh = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("run_id")).agg(count)
    return M.upsert_by_name(prev, fresh, "pipeline_runs")


@query(
    "from_cache_flag", "F13",
    with_(PREV, NEW, "SELECT p.*, NOT EXISTS (SELECT 1 FROM fresh f WHERE f.date = p.date AND f.source = p.source) AS from_cache FROM prev p"),
)
def from_cache_flag(spark, sf):
    return M.from_cache_flag(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), ["date", "source"])


GAPS = """span AS (SELECT min(date) AS lo, max(date) AS hi FROM prev),
missing AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span EXCEPT SELECT date FROM prev)"""


@query("fill_missing_days", "F14, E25", with_(PREV, NEW, GAPS, "SELECT * FROM prev UNION ALL SELECT f.* FROM fresh f SEMI JOIN missing USING (date)"))
def fill_missing_days(spark, sf):
    return M.fill_missing_days(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), "date")


@query("unfilled_days", "F14", with_(PREV, NEW, GAPS, "SELECT date FROM missing WHERE date NOT IN (SELECT date FROM fresh)"))
def unfilled_days(spark, sf):
    return M.unfilled_days(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), "date")


@query(
    "custom_sort_top", "G1, G2",
    """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END,
c_acctbal DESC, c_custkey LIMIT 24""",
)
def custom_sort_top(spark, sf):
    order = [R.custom_rank("c_mktsegment", ["MACHINERY", "BUILDING"]), F.desc("c_acctbal"), F.asc("c_custkey")]
    return R.top_k(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), order, 24)


@query(
    "union_aligned", "G3",
    """SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS side FROM customer UNION ALL
SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier""",
)
def union_aligned(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("side")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("side"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return R.union_aligned([customers, suppliers])


@query(
    "set_difference", "G4",
    "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
)
def set_difference(spark, sf):
    orders = table(spark, sf, "orders")
    keys = lambda status: orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return R.difference(keys("F"), keys("O"))


@query(
    "set_intersection", "G4",
    "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
)
def set_intersection(spark, sf):
    orders = table(spark, sf, "orders")
    keys = lambda status: orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return R.intersection(keys("F"), keys("O"))


@query(
    "inline_values_join", "G5",
    """SELECT v.label, count(*) AS n FROM orders JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'pending')) AS v(code, label)
ON o_orderstatus = v.code GROUP BY v.label""",
)
def inline_values_join(spark, sf):
    labels = R.inline_values(spark, [("F", "filled"), ("O", "open"), ("P", "pending")], "code string, label string")
    orders = table(spark, sf, "orders")
    joined = orders.join(labels, F.col("o_orderstatus") == F.col("code"))
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingestion_order_ties", "G6, F6",
    with_(OFFERS, "SELECT model, date, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY kind DESC, seq DESC) AS rn FROM offers) WHERE rn = 1"),
)
def ingestion_order_ties(spark, sf):
    rows = offers(spark, sf).select("model", "date", "kind", "value", F.col("seq").alias("pos"))
    ordered = R.with_ingestion_order(rows, F.col("kind"), F.col("pos"))
    return M.last_wins(ordered, ["model", "date"], "seq").select("model", "date", F.col("pos").alias("seq"), "value")


@query(
    "ledger_points", "G6, A10",
    with_(OFFERS, "SELECT model, date, seq, value FROM offers"),
)
def ledger_points(spark, sf):
    return ledger(spark, sf)


@query(
    "depth_rows", "D6",
    with_(DEPTH, "SELECT * FROM depth"),
)
def depth_rows(spark, sf):
    return depth(spark, sf)
