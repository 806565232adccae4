"""Evidence-state queries: each clock beside the SQL of its rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import (
    ACTIVITY, DAILY, DEPTH, DEPTH_DAYS, OFFERS, ORDER_MODELS, PRICED, QUARTERLY, USAGE, USAGE_LEDGER,
    activity, daily_depth_totals, day, depth, ledger, offers, priced_usage, quarterly, table, usage, priced_ledger,
)
from tidemark.catalog.q_filings import COMPANY_SQL, GUIDANCE, _guidance_rows
from tidemark.catalog.q_quality import GRADED, _graded
from tidemark.catalog.q_scalars import GUIDE_SQL
from tidemark.catalog.q_series import CUTS, HALVES
from tidemark.catalog.registry import query, with_
from tidemark.operators import aggregates as A
from tidemark.operators import filings as G
from tidemark.operators import quality as Q
from tidemark.operators import series as S
from tidemark.plans import states as P


def _flat(clock, metrics):
    """Clock row with its metrics as columns and its blockers as text."""
    shown = [F.col("metrics")[m].alias(m) for m in metrics]
    return clock.select(
        "clock_id", "state", "direction", "loosening_watch", "intensifying_watch",
        F.array_join("blockers", ",").alias("blockers"), *shown,
    )


def _supply_panels(spark, sf):
    """Panels per (series, kind); the series is the family."""
    prices = A.two_level_median(offers(spark, sf), ["date", "series", "kind"], "provider", "value")
    return S.panel_summary(prices, ["series", "kind"], "date", "value").withColumn("family", F.col("series"))


SUPPLY = """kv AS (SELECT date, series, kind, provider, median(value) AS vote FROM offers GROUP BY ALL),
kd AS (SELECT date, series, kind, median(vote) AS value FROM kv GROUP BY ALL),
kl AS (SELECT series, kind, max(date) AS last_date, arg_max(value, date) AS last_value, count(*) AS n FROM kd GROUP BY ALL),
panels AS (SELECT series AS family, n,
  (last_value / (SELECT arg_max(d.value, d.date) FROM kd d WHERE d.series = l.series AND d.kind = l.kind AND d.date BETWEEN last_date - 40 AND last_date - 20) - 1) * 100 AS c30,
  (last_value / (SELECT arg_max(d.value, d.date) FROM kd d WHERE d.series = l.series AND d.kind = l.kind AND d.date BETWEEN last_date - 100 AND last_date - 80) - 1) * 100 AS c90 FROM kl l),
breadth AS (SELECT count(*) AS panels, count(*) FILTER (WHERE n >= 10) AS chart_ready_panels,
  count(DISTINCT family) FILTER (WHERE n >= 20 AND c30 <= -10) AS declining_families, count(DISTINCT family) FILTER (WHERE n >= 20 AND c30 >= 10) AS rising_families,
  count(DISTINCT family) FILTER (WHERE n >= 60 AND c90 <= -15) AS loosening_confirmed, count(DISTINCT family) FILTER (WHERE n >= 60 AND c90 >= 15) AS intensifying_confirmed FROM panels),
depth_now AS (SELECT count(*) AS depth_valid_dates, arg_max(offers, date) AS depth_latest_total FROM depth_days),
m AS (SELECT breadth.*, depth_now.*, growth_pct AS depth_growth_pct FROM breadth, depth_now, growth),
w AS (SELECT *, coalesce(declining_families >= 2 AND depth_growth_pct >= 10 AND depth_valid_dates >= 20, false) AS loose,
  coalesce(rising_families >= 2 AND depth_growth_pct <= -10 AND depth_valid_dates >= 20, false) AS tight FROM m),
supply AS (SELECT 'supply_price' AS clock_id,
  CASE WHEN panels = 0 THEN 'Unobservable' WHEN chart_ready_panels = 0 THEN 'Observing' WHEN loosening_confirmed >= 2 OR intensifying_confirmed >= 2 THEN 'Confirmed'
       WHEN loose OR tight THEN 'Inflection Watch' ELSE 'Trend' END AS state,
  CASE WHEN panels = 0 OR chart_ready_panels = 0 THEN NULL WHEN loosening_confirmed >= 2 THEN 'loosening' WHEN intensifying_confirmed >= 2 THEN 'intensifying'
       WHEN loose THEN 'loosening' WHEN tight THEN 'intensifying' END AS direction,
  loose AS loosening_watch, tight AS intensifying_watch,
  CASE WHEN panels > 0 AND chart_ready_panels = 0 THEN 'insufficient_panel_history' ELSE '' END AS blockers,
  panels::DOUBLE AS panels, chart_ready_panels::DOUBLE AS chart_ready_panels, declining_families::DOUBLE AS declining_families, rising_families::DOUBLE AS rising_families, loosening_confirmed::DOUBLE AS loosening_confirmed, intensifying_confirmed::DOUBLE AS intensifying_confirmed, depth_valid_dates::DOUBLE AS depth_valid_dates, depth_latest_total::DOUBLE AS depth_latest_total,
  depth_growth_pct FROM w)"""


@query("supply_clock", "J1", with_(OFFERS, DEPTH, DEPTH_DAYS, HALVES, SUPPLY, "SELECT * FROM supply"))
def supply_clock(spark, sf):
    metrics = P.supply_metrics(_supply_panels(spark, sf), daily_depth_totals(spark, sf), "date", "offers")
    return _flat(P.supply_clock(metrics), P.SUPPLY_METRICS)


@query(
    "supply_watch_conditions", "J10",
    with_(OFFERS, DEPTH, DEPTH_DAYS, HALVES, SUPPLY, """names AS (SELECT
  coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (WHERE n >= 20 AND c30 <= -10), '') AS falling,
  coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (WHERE n >= 20 AND c30 >= 10), '') AS rising FROM panels)""",
          """SELECT 'supply_price' AS clock_id, 'loosening' AS direction, 'two_families_down_10pct_30d' AS condition, declining_families >= 2 AS met, falling AS evidence FROM m, names
UNION ALL SELECT 'supply_price', 'loosening', 'depth_up_10pct', coalesce(depth_growth_pct >= 10, false), '' FROM m
UNION ALL SELECT 'supply_price', 'loosening', 'depth_20_valid_days', depth_valid_dates >= 20, '' FROM m
UNION ALL SELECT 'supply_price', 'intensifying', 'two_families_up_10pct_30d', rising_families >= 2, rising FROM m, names
UNION ALL SELECT 'supply_price', 'intensifying', 'depth_down_10pct', coalesce(depth_growth_pct <= -10, false), '' FROM m
UNION ALL SELECT 'supply_price', 'intensifying', 'depth_20_valid_days', depth_valid_dates >= 20, '' FROM m"""),
)
def supply_watch_conditions(spark, sf):
    panels = _supply_panels(spark, sf)
    metrics = P.supply_metrics(panels, daily_depth_totals(spark, sf), "date", "offers")
    return P.supply_watch_conditions(metrics, panels).withColumn("evidence", F.array_join("evidence", ","))


CAPACITY = """gpu AS (SELECT date, CAST(sum(gpus) AS BIGINT) AS gpus FROM offers GROUP BY date),
cap AS (SELECT (SELECT count(*) FROM depth_days) AS n, (SELECT arg_max(offers, date) FROM depth_days) AS latest, growth_pct AS g,
  (SELECT arg_max(gpus, date) FROM gpu) AS gpu_now, (SELECT count(*) FROM offers) AS provider_rows, (SELECT count(DISTINCT provider) FROM offers) AS providers FROM growth),
capacity AS (SELECT 'capacity' AS clock_id, CASE WHEN n = 0 THEN 'Unobservable' WHEN n >= 10 THEN 'Trend' ELSE 'Observing' END AS state, CAST(NULL AS VARCHAR) AS direction,
  coalesce(g >= 25 AND n >= 20, false) AS loosening_watch, coalesce(g <= -25 AND n >= 20, false) AS intensifying_watch,
  CASE WHEN n = 0 THEN 'no_orderbook_history' WHEN n < 10 THEN 'insufficient_orderbook_history_' || n || '_of_10' ELSE '' END AS blockers,
  n::DOUBLE AS depth_valid_dates, latest::DOUBLE AS depth_latest_total, g AS depth_growth_pct, gpu_now::DOUBLE AS latest_gpu_capacity,
  provider_rows::DOUBLE AS provider_rows, providers::DOUBLE AS providers_covered FROM cap)"""


def _capacity(spark, sf):
    rows = offers(spark, sf)
    gpus = rows.groupBy("date").agg(F.sum("gpus").alias("gpus"))
    return P.capacity_clock(
        P.capacity_metrics(daily_depth_totals(spark, sf), "date", "offers", gpus, "gpus", rows, "provider")
    )


@query("capacity_clock", "J2", with_(OFFERS, DEPTH, DEPTH_DAYS, HALVES, CAPACITY, "SELECT * FROM capacity"))
def capacity_clock(spark, sf):
    return _flat(_capacity(spark, sf), P.CAPACITY_METRICS)


DEMAND = """week_price AS (SELECT date, CAST(sum(tokens) AS BIGINT) AS tokens, median(price) AS price FROM priced GROUP BY date),
fp AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, lead(tokens) OVER (ORDER BY date) AS nxt, row_number() OVER (ORDER BY date DESC) AS back FROM week_price),
dm AS (SELECT count(*) FILTER (WHERE NOT coalesce(rn = 1 AND nxt > 0 AND tokens < 0.5 * nxt, false)) AS n, max(tokens) FILTER (WHERE back = 1) AS latest,
  (max(price) FILTER (WHERE back = 1) / max(price) FILTER (WHERE back = 8) - 1) * 100 AS change, (SELECT count(*) FROM cut_models) AS cuts,
  (SELECT count(DISTINCT n_name) FROM order_models) AS labs FROM fp),
demand AS (SELECT 'demand_unit_economics' AS clock_id, CASE WHEN n = 0 THEN 'Unobservable' WHEN n >= 52 THEN 'Trend' ELSE 'Observing' END AS state, CAST(NULL AS VARCHAR) AS direction,
  false AS loosening_watch, false AS intensifying_watch,
  CASE WHEN n = 0 THEN 'no_usage_series,' WHEN n < 52 THEN 'incomplete_weeks_' || n || '_of_52,' ELSE '' END || 'proxy_ceiling_requires_official_usage_for_inflection' AS blockers,
  n::DOUBLE AS complete_periods, latest::DOUBLE AS latest_weekly_tokens, change AS price_change_8w_pct, cuts::DOUBLE AS recent_price_cut_models, labs::DOUBLE AS labs_covered FROM dm)"""


def _demand(spark, sf):
    priced = priced_usage(spark, sf)
    totals = priced.groupBy("date").agg(F.sum("tokens").alias("tokens"))
    weeks = totals.join(A.pooled_median(priced, ["date"], "price", "price"), ["date"], "left")
    labs = quarterly(spark, sf)
    return P.demand_clock(
        P.demand_metrics(
            weeks, "date", "tokens", "price", priced_ledger(spark, sf), ["model"], "date", "seq", "value",
            labs, "entity", "date", day("2001-08-01"), ledger_beside="output",
        )
    )


@query("demand_clock", "J3", with_(OFFERS, USAGE, USAGE_LEDGER, PRICED, CUTS, DEMAND, "SELECT * FROM demand"))
def demand_clock(spark, sf):
    return _flat(_demand(spark, sf), P.DEMAND_METRICS)


# Spending rows: quarterly totals at or above the nation's mean are actuals, all of them state guidance.
SPEND = """means AS (SELECT entity, sum(value) / count(*) AS mean_value FROM quarterly GROUP BY entity),
spend AS (
  SELECT entity AS company, date, 100000 - (fy * 4 + q) AS seq, 'capex actual' AS metric, 'FY' || fy || ' Q' || q AS period, value::DOUBLE AS value
  FROM quarterly JOIN means USING (entity) WHERE value >= mean_value
  UNION ALL SELECT entity, date, 100000 - (fy * 4 + q), 'fy' || fy || CASE WHEN q IN (1, 3) THEN ' capex guidance low' ELSE ' capex guidance previous low' END, 'FY' || fy, value::DOUBLE FROM quarterly),
bands AS (SELECT date, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high FROM quarterly GROUP BY date)"""


def spend_rows(spark, sf):
    rows = quarterly(spark, sf)
    means = rows.groupBy("entity").agg((F.sum("value") / F.count(F.lit(1))).alias("_mean"))
    fy = F.col("fy").cast("string")
    base = rows.withColumn("seq", 100000 - (F.col("fy") * 4 + F.col("q"))).withColumn("value", F.col("value").cast("double"))
    actual = base.join(means, "entity").where("value >= _mean").select(
        F.col("entity").alias("company"), "date", "seq", F.lit("capex actual").alias("metric"),
        F.concat(F.lit("FY"), fy, F.lit(" Q"), F.col("q").cast("string")).alias("period"), "value",
    )
    kind = F.when(F.col("q").isin(1, 3), " capex guidance low").otherwise(" capex guidance previous low")
    guidance = base.select(
        F.col("entity").alias("company"), "date", "seq", F.concat(F.lit("fy"), fy, kind).alias("metric"),
        F.concat(F.lit("FY"), fy).alias("period"), "value",
    )
    return actual.unionByName(guidance)


COMMITMENT = """steps AS (SELECT DISTINCT company, CAST(substr(period, 3, 4) AS INTEGER) * 4 + CAST(right(period, 1) AS INTEGER) AS o FROM spend WHERE metric = 'capex actual'),
islands AS (SELECT company, o - row_number() OVER (PARTITION BY company ORDER BY o) AS g FROM steps),
runs AS (SELECT company, max(n) AS run FROM (SELECT company, g, count(*) AS n FROM islands GROUP BY ALL) GROUP BY company),
lows AS (SELECT company, arg_min(value, seq) FILTER (WHERE metric LIKE '%guidance low') AS low, arg_min(value, seq) FILTER (WHERE metric LIKE '%previous low') AS prev_low FROM spend GROUP BY company),
mids AS (SELECT arg_min((low + high) / 2, date) AS first_midpoint, arg_max((low + high) / 2, date) AS latest_midpoint FROM bands WHERE low > 0),
cm AS (SELECT (SELECT count(*) FROM runs) AS n, (SELECT count(*) FROM runs WHERE run >= 3) AS good, (SELECT max(run) FROM runs) AS best,
  (SELECT company FROM runs ORDER BY run DESC, company LIMIT 1) AS who,
  (SELECT count(*) FROM lows WHERE low > prev_low) AS up, (SELECT count(*) FROM lows WHERE low < prev_low) AS down, mids.* FROM mids),
commitment AS (SELECT 'commitment_monetization' AS clock_id, CASE WHEN down >= 2 OR up >= 2 THEN 'Inflection Watch' WHEN n = 0 THEN 'Unobservable' WHEN good >= 3 THEN 'Trend' ELSE 'Observing' END AS state,
  CASE WHEN down >= 2 THEN 'loosening' WHEN up >= 2 THEN 'intensifying' END AS direction, down >= 2 AS loosening_watch, up >= 2 AS intensifying_watch,
  CASE WHEN n = 0 THEN 'no_capex_actuals' WHEN good < 3 THEN 'companies_with_3_consecutive_quarters_' || good || '_of_3,longest_true_quarter_run_' || best || '_(' || who || ')_needs_3' ELSE '' END AS blockers,
  n::DOUBLE AS companies_covered, good::DOUBLE AS companies_with_run, best::DOUBLE AS max_run, up::DOUBLE AS guidance_up, down::DOUBLE AS guidance_down, first_midpoint, latest_midpoint FROM cm)"""


def _commitment(spark, sf):
    bands = quarterly(spark, sf).groupBy("date").agg(
        F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high")
    )
    return P.commitment_clock(P.commitment_metrics(spend_rows(spark, sf), bands))


@query("commitment_clock", "J4, I8, E13", with_(ORDER_MODELS, QUARTERLY, SPEND, COMMITMENT, "SELECT * FROM commitment"))
def commitment_clock(spark, sf):
    return _flat(_commitment(spark, sf), P.COMMITMENT_METRICS)


ONE_WAY_DEPTH = """ow AS (SELECT count(*) AS depth_valid_dates, arg_min(offers, date) AS f, arg_max(offers, date) AS l FROM depth_days),
ent AS (SELECT source, count(*) AS n, arg_min(offers, date) AS f, arg_max(offers, date) AS l FROM depth GROUP BY source),
owd AS (SELECT depth_valid_dates, CASE WHEN depth_valid_dates >= 20 AND f <> 0 THEN (l / f - 1) * 100 END AS depth_growth_pct,
  (SELECT count(*) FROM ent WHERE n >= 20 AND f > 0 AND (l / f - 1) * 100 >= 25) AS expanding_breadth FROM ow)"""


@query(
    "one_way_capacity_clock", "J6",
    with_(DEPTH, DEPTH_DAYS, ONE_WAY_DEPTH, """SELECT 'capacity_utilization' AS clock_id, CASE WHEN depth_valid_dates = 0 THEN 'Unobservable' WHEN depth_valid_dates < 10 THEN 'Observing'
  WHEN depth_valid_dates < 20 THEN 'Trend' WHEN depth_valid_dates >= 60 AND expanding_breadth >= 2 THEN 'Confirmed'
  WHEN depth_growth_pct >= 25 AND expanding_breadth >= 2 THEN 'Inflection Watch' ELSE 'Trend' END AS state, CAST(NULL AS VARCHAR) AS direction, false AS loosening_watch, false AS intensifying_watch,
  CASE WHEN depth_valid_dates = 0 THEN 'no_capacity_history' WHEN depth_valid_dates < 10 THEN 'insufficient_capacity_history' WHEN depth_valid_dates < 20 THEN 'insufficient_30d_duration'
  WHEN expanding_breadth >= 2 AND (depth_valid_dates >= 60 OR coalesce(depth_growth_pct >= 25, false)) THEN '' ELSE 'capacity_breadth_not_expanding' END AS blockers,
  depth_valid_dates::DOUBLE AS depth_valid_dates, depth_growth_pct, expanding_breadth::DOUBLE AS expanding_breadth FROM owd"""),
)
def one_way_capacity_clock(spark, sf):
    metrics = P.one_way_depth(depth(spark, sf), "source", "date", "offers")
    return _flat(P.one_way_capacity_clock(metrics), ["depth_valid_dates", "depth_growth_pct", "expanding_breadth"])


def _panel_points(spark, sf):
    """Per provider and day: change against the provider's previous day, eligibility by history length."""
    from pyspark.sql import Window

    days = A.pooled_median(offers(spark, sf), ["provider", "date"], "value")
    w = Window.partitionBy("provider").orderBy("date")
    n = F.row_number().over(w)
    c30 = (F.col("value") / F.lag("value").over(w) - 1) * 100
    c90 = (F.col("value") / F.lag("value", 3).over(w) - 1) * 100
    return days.select(
        F.col("provider").alias("panel_id"), "date", c30.alias("change_30d_pct"), c90.alias("change_90d_pct"),
        (n >= 10).alias("eligible_for_chart"), (n >= 20).alias("eligible_for_inflection"), (n >= 60).alias("eligible_for_90d"),
    )


@query(
    "one_way_supply_clock", "J5",
    with_(OFFERS, DEPTH, DEPTH_DAYS, ONE_WAY_DEPTH, """pd AS (SELECT provider, date, median(value) AS v FROM offers GROUP BY ALL),
pts AS (SELECT provider, date, (v / lag(v) OVER w - 1) * 100 AS c30, (v / lag(v, 3) OVER w - 1) * 100 AS c90, row_number() OVER w AS n FROM pd WINDOW w AS (PARTITION BY provider ORDER BY date)),
lat AS (SELECT provider, arg_max(c30, date) AS c30, arg_max(c90, date) AS c90, max(n) AS n FROM pts GROUP BY provider),
m AS (SELECT count(*) AS panel_count, count(*) FILTER (WHERE n >= 10) AS chart_ready_panels, count(*) FILTER (WHERE n >= 20) AS inflection_ready_panels,
  count(*) FILTER (WHERE c30 <= -10) AS decline_30d_breadth, count(*) FILTER (WHERE n >= 60 AND c90 <= -15) AS confirmed_90d_breadth,
  (SELECT count(*) FROM (SELECT DISTINCT series, provider FROM offers)) AS exact_series, (SELECT depth_valid_dates FROM owd) AS dv, (SELECT depth_growth_pct FROM owd) AS dg FROM lat),
b AS (SELECT *, concat_ws(',', CASE WHEN inflection_ready_panels < 2 THEN 'insufficient_30d_duration' END, CASE WHEN decline_30d_breadth < 2 THEN 'insufficient_market_breadth' END,
  CASE WHEN dv < 20 OR dg IS NULL OR dg < 10 THEN 'depth_not_confirming' END) AS missing FROM m)""",
          """SELECT 'supply_price' AS clock_id, CASE WHEN exact_series = 0 THEN 'Unobservable' WHEN panel_count = 0 OR chart_ready_panels = 0 THEN 'Observing'
  WHEN confirmed_90d_breadth >= 2 THEN 'Confirmed' WHEN missing = '' THEN 'Inflection Watch' ELSE 'Trend' END AS state, CAST(NULL AS VARCHAR) AS direction,
  false AS loosening_watch, false AS intensifying_watch, CASE WHEN exact_series = 0 THEN 'no_exact_configuration_series' WHEN panel_count = 0 THEN 'no_fixed_matched_panel'
  WHEN chart_ready_panels = 0 THEN 'insufficient_panel_history' WHEN confirmed_90d_breadth >= 2 THEN '' ELSE missing END AS blockers,
  exact_series::DOUBLE AS exact_series, panel_count::DOUBLE AS panel_count, chart_ready_panels::DOUBLE AS chart_ready_panels, inflection_ready_panels::DOUBLE AS inflection_ready_panels,
  decline_30d_breadth::DOUBLE AS decline_30d_breadth, confirmed_90d_breadth::DOUBLE AS confirmed_90d_breadth, dv::DOUBLE AS depth_valid_dates, dg AS depth_growth_pct FROM b"""),
)
def one_way_supply_clock(spark, sf):
    exact = offers(spark, sf).select("series", "provider").distinct()
    depth_row = P.one_way_depth(depth(spark, sf), "source", "date", "offers")
    metrics = P.one_way_supply_metrics(_panel_points(spark, sf), exact, depth_row)
    return _flat(P.one_way_supply_clock(metrics), P.ONE_WAY_SUPPLY_METRICS)


@query(
    "one_way_demand_clock", "J7",
    with_(OFFERS, DEPTH, USAGE, ACTIVITY, GRADED, """ev AS (SELECT model, date, value / lag(value) OVER (PARTITION BY model ORDER BY date, seq) - 1 AS change, kind FROM offers),
m AS (SELECT count(*) AS usage_series, count(*) FILTER (WHERE chart) AS chart_ready_series, count(*) FILTER (WHERE chart AND proxy) AS proxy_series,
  count(*) FILTER (WHERE infl AND NOT proxy) AS official_inflection_series, (SELECT count(*) FROM ev WHERE kind = 'F' AND change < 0) AS cuts,
  (SELECT count(*) FROM ev WHERE kind = 'O' AND change > 0) AS ups FROM steps)""",
          """SELECT 'demand_unit_economics' AS clock_id, CASE WHEN usage_series = 0 AND cuts = 0 THEN 'Unobservable' WHEN chart_ready_series = 0 THEN 'Observing'
  WHEN official_inflection_series >= 2 AND cuts >= 3 AND ups >= 2 THEN 'Confirmed' WHEN official_inflection_series > 0 AND cuts >= 3 THEN 'Inflection Watch' ELSE 'Trend' END AS state,
  CAST(NULL AS VARCHAR) AS direction, false AS loosening_watch, false AS intensifying_watch,
  CASE WHEN usage_series = 0 AND cuts = 0 THEN 'no_usage_or_price_change_series' WHEN chart_ready_series = 0 THEN 'insufficient_usage_history'
  WHEN official_inflection_series > 0 AND cuts >= 3 THEN '' WHEN proxy_series > 0 THEN 'proxy_not_inflection_eligible' ELSE 'usage_price_bridge_unconfirmed' END AS blockers,
  usage_series::DOUBLE AS usage_series, chart_ready_series::DOUBLE AS chart_ready_series, proxy_series::DOUBLE AS proxy_series, official_inflection_series::DOUBLE AS official_inflection_series,
  cuts::DOUBLE AS negative_price_changes, ups::DOUBLE AS positive_commercial_changes FROM m"""),
)
def one_way_demand_clock(spark, sf):
    from tidemark.operators.ordered import lag_in_order

    graded = Q.series_quality(_graded(spark, sf), ["series", "proxy"], "date", "freq", "proxy").withColumn(
        "evidence_class", F.when(F.col("proxy"), "public_proxy").otherwise("official")
    )
    # A proxy never passes beyond charting, so its inflection flag is already false.
    points = lag_in_order(offers(spark, sf).select("model", "date", "seq", "kind", "value"), ["model"], "date", "seq", ["value"])
    filled = F.col("kind") == "F"
    events = points.select(
        F.when(filled, "token_price").otherwise("app_commercialization").alias("track"),
        F.when(filled, "price_change").otherwise("value_change").alias("event_type"),
        (F.col("value") / F.col("prev_value") - 1).alias("change_pct"),
    )
    metrics = P.one_way_demand_metrics(graded, events)
    names = [
        "usage_series", "chart_ready_series", "proxy_series", "official_inflection_series",
        "negative_price_changes", "positive_commercial_changes",
    ]
    return _flat(P.one_way_demand_clock(metrics), names)


@query(
    "one_way_commitment_clock", "J8, C4, E12",
    with_(ORDER_MODELS, QUARTERLY, """per AS (SELECT entity, count(DISTINCT date) AS n FROM quarterly GROUP BY entity),
l AS (SELECT entity, value, lag(value) OVER (PARTITION BY entity ORDER BY date) AS prior FROM quarterly),
g AS (SELECT a.entity, a.value AS cur, b.value AS prev FROM quarterly a JOIN quarterly b ON a.entity = b.entity AND b.date = a.date - INTERVAL 3 MONTH),
m AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM per) AS ev, (SELECT count(*) FROM per WHERE n >= 2) AS seqc, (SELECT count(*) FROM per WHERE n >= 3) AS trend,
  (SELECT count(DISTINCT entity) FROM l WHERE value < prior) AS dec, (SELECT count(DISTINCT entity) FROM g WHERE cur < prev) AS neg, (SELECT count(DISTINCT entity) FROM g WHERE cur > prev) AS pos)""",
          """SELECT 'commitment_monetization' AS clock_id, CASE WHEN ev = 0 THEN 'Unobservable' WHEN dec >= 2 THEN 'Confirmed' WHEN neg >= 2 THEN 'Inflection Watch' WHEN trend >= 3 THEN 'Trend' ELSE 'Observing' END AS state,
  CAST(NULL AS VARCHAR) AS direction, false AS loosening_watch, false AS intensifying_watch,
  CASE WHEN ev = 0 THEN 'no_official_commitment_events' WHEN dec < 2 AND neg < 2 AND trend < 3 THEN 'insufficient_sequential_quarters' ELSE '' END AS blockers,
  ev::DOUBLE AS event_count, seqc::DOUBLE AS sequential_companies, trend::DOUBLE AS trend_companies, dec::DOUBLE AS declining, neg::DOUBLE AS negative_guidance, pos::DOUBLE AS positive_guidance FROM m"""),
)
def one_way_commitment_clock(spark, sf):
    rows = quarterly(spark, sf).select("entity", "date", "value")
    current = rows.withColumn("metric", F.lit("capex_low"))
    previous = rows.withColumn("date", F.add_months("date", 3)).withColumn("metric", F.lit("capex_previous_low"))
    metrics = P.one_way_commitment_metrics(
        rows.withColumn("series_id", F.col("entity")), current.unionByName(previous)
    )
    names = [
        "event_count", "sequential_companies", "trend_companies", "declining", "negative_guidance", "positive_guidance",
    ]
    return _flat(P.one_way_commitment_clock(metrics), names)


def _all_clocks(spark, sf):
    panels = _supply_panels(spark, sf)
    supply = P.supply_clock(P.supply_metrics(panels, daily_depth_totals(spark, sf), "date", "offers"))
    return P.evaluate(
        {
            "supply": supply,
            "capacity": _capacity(spark, sf),
            "demand": _demand(spark, sf),
            "commitment": _commitment(spark, sf),
        },
        day("2001-08-01"),
    )


FOUR = (OFFERS, DEPTH, DEPTH_DAYS, HALVES, SUPPLY, CAPACITY, USAGE, USAGE_LEDGER, PRICED, CUTS, DEMAND, QUARTERLY, SPEND, COMMITMENT)
CLOCKS = """clocks AS (SELECT clock_id, state, direction FROM supply UNION ALL SELECT clock_id, state, direction FROM capacity
  UNION ALL SELECT clock_id, state, direction FROM demand UNION ALL SELECT clock_id, state, direction FROM commitment)"""


@query("evaluate_report", "J1, J2, J3, J4", with_(*FOUR, CLOCKS, "SELECT *, DATE '2001-08-01' AS as_of FROM clocks"))
def evaluate_report(spark, sf):
    return _all_clocks(spark, sf).select("clock_id", "state", "direction", "as_of")


@query(
    "stance", "J11",
    with_(*FOUR, CLOCKS, COMPANY_SQL, GUIDANCE, """k AS (SELECT * FROM buckets WHERE low IS NOT NULL AND high IS NOT NULL AND prev_low IS NOT NULL AND prev_high IS NOT NULL),
moved AS (SELECT count(*) FILTER (WHERE low > prev_low OR high > prev_high) AS ups, count(*) FILTER (WHERE low < prev_low OR high < prev_high) AS downs FROM k),
p AS (SELECT max(state) FILTER (WHERE clock_id = 'supply_price') AS s, max(direction) FILTER (WHERE clock_id = 'supply_price') AS d,
  max(direction) FILTER (WHERE clock_id = 'commitment_monetization') AS c FROM clocks)""",
          """SELECT CASE WHEN s = 'Confirmed' AND d = 'intensifying' THEN 'intensifying' WHEN s = 'Confirmed' AND d = 'loosening' THEN 'loosening' WHEN s = 'Inflection Watch' THEN 'watch' ELSE 'neutral' END AS level,
  CASE WHEN s = 'Confirmed' AND d = 'intensifying' THEN CASE WHEN downs > 0 THEN 'guidance_mixed' WHEN c = 'intensifying' AND ups > 0 THEN 'guidance_partly_raised' ELSE 'guidance_not_confirming' END END AS guidance_note FROM p, moved"""),
)
def stance(spark, sf):
    moves = G.guidance_moves(G.guidance_buckets(_guidance_rows(spark, sf)))
    counted = lambda move: moves.where(F.col("move") == move).agg(F.count(F.lit(1))).scalar()
    return P.stance(_all_clocks(spark, sf), counted("up"), counted("down"))


# A state per source and month from how its depth compares with the month before.
MONTHS = """months AS (SELECT source AS clock_id, CAST(date_trunc('month', date) AS DATE) AS as_of, CAST(sum(offers) AS BIGINT) AS n FROM depth GROUP BY ALL),
st AS (SELECT clock_id, as_of, n, lag(n) OVER (PARTITION BY clock_id ORDER BY as_of) AS p FROM months),
hist AS (SELECT clock_id, as_of, CASE WHEN p IS NULL THEN 'Observing' WHEN n * 10 >= p * 12 THEN 'Confirmed' WHEN n * 10 >= p * 11 THEN 'Inflection Watch' WHEN n >= p THEN 'Trend' ELSE 'Observing' END AS state FROM st),
ranks(state, r) AS (VALUES ('Unobservable', 1), ('Observing', 2), ('Trend', 3), ('Inflection Watch', 4), ('Confirmed', 5))"""


def _history(spark, sf):
    from pyspark.sql import Window

    months = depth(spark, sf).groupBy(F.col("source").alias("clock_id"), F.trunc("date", "month").alias("as_of")).agg(
        F.sum("offers").alias("n")
    )
    p = F.lag("n").over(Window.partitionBy("clock_id").orderBy("as_of"))
    rows = months.withColumn("p", p)
    state = P.decide(
        [
            (F.col("p").isNull(), "Observing"),
            (F.col("n") * 10 >= F.col("p") * 12, "Confirmed"),
            (F.col("n") * 10 >= F.col("p") * 11, "Inflection Watch"),
            (F.col("n") >= F.col("p"), "Trend"),
        ],
        "Observing",
    )
    return rows.select("clock_id", "as_of", state.alias("state"))


@query(
    "transitions", "J9",
    with_(DEPTH, MONTHS, """prev AS (SELECT * FROM hist WHERE as_of = DATE '2001-05-01' AND clock_id <> '5-LOW'), cur AS (SELECT * FROM hist WHERE as_of = DATE '2001-06-01')""",
          """SELECT clock_id, p.state AS from_state, c.state AS to_state, CASE WHEN p.state IS NULL THEN 'initial_state' WHEN rc.r > rp.r THEN 'upgrade' ELSE 'downgrade' END AS change_type
FROM cur c LEFT JOIN prev p USING (clock_id) LEFT JOIN ranks rc ON rc.state = c.state LEFT JOIN ranks rp ON rp.state = p.state WHERE p.state IS DISTINCT FROM c.state"""),
)
def transitions(spark, sf):
    rows = _history(spark, sf)
    prev = rows.where((F.col("as_of") == day("2001-05-01")) & (F.col("clock_id") != "5-LOW"))
    return P.transitions(prev, rows.where(F.col("as_of") == day("2001-06-01")))


@query(
    "state_history", "J13",
    with_(DEPTH, MONTHS, "h AS (SELECT clock_id, as_of, state AS to_state, lag(state) OVER (PARTITION BY clock_id ORDER BY as_of) AS from_state FROM hist)",
          """SELECT clock_id, as_of, from_state, to_state, CASE WHEN from_state IS NULL THEN 'initial_state' WHEN rc.r > rp.r THEN 'upgrade' ELSE 'downgrade' END AS change_type
FROM h LEFT JOIN ranks rc ON rc.state = to_state LEFT JOIN ranks rp ON rp.state = from_state WHERE from_state IS DISTINCT FROM to_state"""),
)
def state_history(spark, sf):
    return P.state_history(_history(spark, sf))


@query(
    "evidence_rows", "J12, G2",
    with_(OFFERS, "q AS (SELECT series, provider, count(DISTINCT date) AS valid_dates, min(date) AS first_date, max(date) AS last_date FROM offers GROUP BY ALL)",
          "SELECT * FROM q ORDER BY valid_dates DESC, series, provider LIMIT 8"),
)
def evidence_rows(spark, sf):
    quality = offers(spark, sf).groupBy("series", "provider").agg(
        F.count_distinct("date").alias("valid_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    columns = ["series", "provider", "valid_dates", "first_date", "last_date"]
    return P.evidence_rows(quality, columns, [F.desc("valid_dates"), F.asc("series"), F.asc("provider")])
