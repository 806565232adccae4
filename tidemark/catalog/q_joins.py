"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import (
    DAILY, DEPTH, NEW, OFFERS, ORDER_MODELS, PANEL, PREV, PRICED, QUARTERLY, USAGE, USAGE_LEDGER,
    daily_prices, day, depth, offers, priced_usage, quarterly, snapshots, table, usage, weekly_panel,
)
from tidemark.catalog.q_scalars import NAMES_SQL, _names
from tidemark.catalog.registry import query, with_
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J


@query("asof_price", "C1", with_(USAGE, USAGE_LEDGER, PRICED, "SELECT * FROM priced"))
def asof_price(spark, sf):
    return priced_usage(spark, sf)


@query(
    "resolve_alias", "C2",
    """WITH aliases AS (SELECT p_brand AS alias, min(p_type) AS target FROM part GROUP BY p_brand HAVING count(*) % 2 = 0),
history AS (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) % 3 = 0)
SELECT p_partkey, coalesce(target, h.p_brand) AS base_id FROM part p LEFT JOIN aliases a ON p.p_brand = a.alias
LEFT JOIN history h ON p.p_brand = h.p_brand""",
)
def resolve_alias(spark, sf):
    parts = table(spark, sf, "part")
    brands = parts.groupBy("p_brand").agg(F.min("p_type").alias("target"), F.count(F.lit(1)).alias("n"))
    aliases = brands.where("n % 2 = 0").select(F.col("p_brand").alias("alias"), "target")
    history = brands.where("n % 3 = 0").select(F.col("p_brand").alias("known"))
    out = J.resolve_alias(parts, "p_brand", aliases, history, "alias", "target", "known", "base_id")
    return out.select("p_partkey", "base_id")


@query(
    "first_candidate_price", "C3",
    with_(NAMES_SQL, """catalog AS (SELECT regexp_replace(substr(p_type || '/' || replace(p_name, ' ', '-'), 1), '^', '') AS key,
    CAST(max(p_size) AS DOUBLE) AS cost FROM part GROUP BY 1)""",
          """SELECT n.p_partkey, cost * 1000000 AS input_price, CAST(NULL AS DOUBLE) AS output_price, key AS matched_key
FROM names n LEFT JOIN catalog c ON regexp_replace(n.name, '-20\\d{6}$', '') = c.key"""),
)
def first_candidate_price(spark, sf):
    base = F.concat(F.col("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    catalog = table(spark, sf, "part").groupBy(base.alias("key")).agg(F.max("p_size").cast("double").alias("cost"))
    catalog = catalog.withColumn("none", F.lit(None).cast("double"))
    out = J.first_candidate_join(_names(spark, sf), "name", catalog, "key", "cost", "none")
    return out.select("p_partkey", "input_price", "output_price", "matched_key")


@query(
    "current_with_previous", "C4",
    with_(ORDER_MODELS, QUARTERLY, """SELECT a.entity, a.date, 'capex_low' AS metric, a.value AS current_value, b.value AS previous_value
FROM quarterly a JOIN quarterly b ON a.entity = b.entity AND b.date = a.date - INTERVAL 3 MONTH"""),
)
def current_with_previous(spark, sf):
    rows = quarterly(spark, sf).select("entity", "date", "value")
    current = rows.withColumn("metric", F.lit("capex_low"))
    previous = rows.withColumn("date", F.add_months("date", 3)).withColumn("metric", F.lit("capex_previous_low"))
    return J.current_with_previous(current.unionByName(previous), "entity", "date", "metric", "value")


@query(
    "left_join_in_on", "C5",
    """SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_orderstatus = 'F' AND o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""",
)
def left_join_in_on(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    on = (
        (F.col("o_orderstatus") == "F") & (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == "BUILDING")
    )
    return J.left_join_where(orders, customers, on).select("o_orderkey", "c_name")


@query(
    "on_latest_day", "C6",
    with_(DEPTH, "SELECT date, source, offers FROM depth WHERE date = (SELECT max(date) FROM depth)"),
)
def on_latest_day(spark, sf):
    return J.on_latest(depth(spark, sf), "date")


@query(
    "restrict_to_selected", "C7",
    with_(OFFERS, """selected AS (SELECT series, provider FROM offers GROUP BY ALL HAVING count(DISTINCT date) >= 5)""",
          "SELECT date, series, provider, seq, model FROM offers SEMI JOIN selected USING (series, provider)"),
)
def restrict_to_selected(spark, sf):
    rows = offers(spark, sf)
    chosen = A.having_distinct(rows, ["series", "provider"], "date", 5, "date")
    return J.restrict_to(rows, chosen, ["series", "provider"]).select("date", "series", "provider", "seq", "model")


@query(
    "depth_with_prices", "C8",
    with_(OFFERS, DEPTH, """days AS (SELECT date, CAST(sum(offers) AS BIGINT) AS offers FROM depth GROUP BY date),
prices AS (SELECT date, quantile_cont(value, 0.25) AS p25, median(value) AS p50, quantile_cont(value, 0.75) AS p75 FROM offers GROUP BY date)""",
          "SELECT * FROM days LEFT JOIN prices USING (date)"),
)
def depth_with_prices(spark, sf):
    days = depth(spark, sf).groupBy("date").agg(F.sum("offers").alias("offers"))
    prices = A.quartiles_inclusive(offers(spark, sf), ["date"], "value")
    return days.join(prices, ["date"], "left")


@query(
    "ratio_to_base", "C9",
    with_(OFFERS, DAILY, """SELECT a.date, a.series, a.value / b.value AS ratio FROM daily a JOIN daily b USING (date)
WHERE a.series <> 'A' AND b.series = 'A' AND b.value <> 0"""),
)
def ratio_to_base(spark, sf):
    return J.ratio_to_base(daily_prices(spark, sf), "series", "date", "value", "A")


@query(
    "nearest_match", "C10, D26",
    # The walk takes one driving day at a time and remembers which other days are used.
    with_("RECURSIVE " + OFFERS, PANEL, ORDER_MODELS, QUARTERLY, """sides AS (
  SELECT s.series || '|' || entity AS pair, true AS is_left, date AS t, value::DOUBLE AS v FROM quarterly, (SELECT DISTINCT series FROM panel) s
  UNION ALL SELECT series || '|' || member, false, date, value::DOUBLE FROM panel),
lists AS (SELECT pair, list({'t': t, 'v': v} ORDER BY t) FILTER (WHERE is_left) AS l, list({'t': t, 'v': v} ORDER BY t) FILTER (WHERE NOT is_left) AS r FROM sides GROUP BY pair),
tasks AS (SELECT pair, len(l) <= len(r) AS left_drives, CASE WHEN len(l) <= len(r) THEN l ELSE r END AS drv, CASE WHEN len(l) <= len(r) THEN r ELSE l END AS oth
  FROM lists WHERE l IS NOT NULL AND r IS NOT NULL),
walk AS (
  SELECT pair, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS best FROM tasks
  UNION ALL
  SELECT pair, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best FROM (
    SELECT w.pair, w.i + 1 AS i, w.used AS used, list_sort(list_filter(list_transform(range(1, len(t.oth) + 1),
      lambda j: {'gap': abs(date_diff('day', t.drv[w.i + 1].t, t.oth[j].t)), 'j': j}), lambda x: x.gap <= 7 AND NOT list_contains(w.used, x.j)))[1].j AS best
    FROM walk w JOIN tasks t ON w.pair = t.pair WHERE w.i < len(t.drv))),
found AS (SELECT w.pair, CASE WHEN left_drives THEN drv[i].v ELSE oth[best].v END AS x, CASE WHEN left_drives THEN oth[best].v ELSE drv[i].v END AS y
  FROM walk w JOIN tasks t ON w.pair = t.pair WHERE best IS NOT NULL)""",
          """SELECT pair, count(*) AS pairs, round(CASE WHEN count(*) < 5 THEN NULL WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS r
FROM found GROUP BY pair"""),
)
def nearest_match(spark, sf):
    every = F.explode(F.array(*[F.lit(s) for s in ("A", "N", "R")])).alias("series")
    spending = quarterly(spark, sf).select(every, "entity", "date", "value")
    spending = spending.select(F.concat_ws("|", "series", "entity").alias("pair"), "date", "value")
    prices = weekly_panel(spark, sf).select(F.concat_ws("|", "series", "member").alias("pair"), "date", "value")
    pairs = J.nearest_match(spending, prices, "pair", "date", "value")
    return A.pearson(pairs, ["pair"], "left_value", "right_value").withColumn("r", F.round("r", 6))


@query(
    "key_difference", "C11, G4",
    with_(PREV, NEW, "SELECT DISTINCT date FROM prev WHERE date NOT IN (SELECT date FROM fresh)"),
)
def key_difference(spark, sf):
    return J.key_difference(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), ["date"])


@query(
    "key_intersection", "C11, G4",
    with_(PREV, NEW, "SELECT date FROM prev INTERSECT SELECT date FROM fresh"),
)
def key_intersection(spark, sf):
    return J.key_intersection(snapshots(spark, sf, "F"), snapshots(spark, sf, "O"), ["date"])


@query(
    "snapshot_on_or_before", "C12",
    with_(USAGE, DEPTH, """weeks AS (SELECT DISTINCT date AS week, least(date + 6, DATE '2001-07-15') AS due FROM usage),
snaps AS (SELECT date, CAST(sum(offers) AS BIGINT) AS offers FROM depth GROUP BY date)""",
          "SELECT week, due AS date, offers, s.date AS snapshot_date FROM weeks ASOF LEFT JOIN snaps s ON weeks.due >= s.date"),
)
def snapshot_on_or_before(spark, sf):
    weeks = usage(spark, sf).select(F.col("date").alias("week")).distinct()
    days = depth(spark, sf).groupBy("date").agg(F.sum("offers").alias("offers"))
    snaps = days.select("date", "offers", F.col("date").alias("snapshot_date"))
    return J.snapshot_on_or_before(weeks, snaps, "week", "date", ["offers", "snapshot_date"], day("2001-07-15"))
