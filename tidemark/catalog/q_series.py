"""Time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import (
    ACTIVITY, DAILY, DEPTH, DEPTH_DAYS, NEW, OFFERS, ORDER_MODELS, PANEL, PREV, QUARTERLY, STRONG, USAGE,
    activity, daily_depth_totals, daily_prices, day, depth, ledger, offers, quarterly, snapshots,
    strong_quarters, usage, weekly_panel, PRICED_LEDGER,
)
from tidemark.catalog.q_aggregates import SHARES
from tidemark.catalog.registry import query, with_
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import series as S

CHANGES = """latest AS (SELECT series, max(date) AS last_date, arg_max(value, date) AS last_value, count(*) AS n FROM daily GROUP BY series),
changes AS (
  SELECT series, n,
    (SELECT arg_max(d.value, d.date) FROM daily d WHERE d.series = l.series AND d.date BETWEEN l.last_date - 40 AND l.last_date - 20) AS base30,
    (SELECT arg_max(d.value, d.date) FROM daily d WHERE d.series = l.series AND d.date BETWEEN l.last_date - 100 AND l.last_date - 80) AS base90,
    last_value FROM latest l)"""
PCT30 = "CASE WHEN n >= 2 AND base30 > 0 THEN (last_value / base30 - 1) * 100 END"
PCT90 = "CASE WHEN n >= 2 AND base90 > 0 THEN (last_value / base90 - 1) * 100 END"


@query("change_pct_window", "E1", with_(OFFERS, DAILY, CHANGES, f"SELECT series, {PCT30} AS change_pct FROM changes"))
def change_pct_window(spark, sf):
    return S.change_pct_window(daily_prices(spark, sf), ["series"], "date", "value", 30)


@query(
    "change_pct_nearest", "E1",
    with_(OFFERS, DAILY, """latest AS (SELECT series, max(date) AS last_date, arg_max(value, date) AS last_value FROM daily GROUP BY series),
near AS (SELECT d.series, d.value, last_value, row_number() OVER (PARTITION BY d.series
    ORDER BY abs((d.date - last_date) + 30), d.date DESC) AS rn
  FROM daily d JOIN latest l ON d.series = l.series AND d.date BETWEEN last_date - 40 AND last_date - 20)""",
          "SELECT series, (last_value / value - 1) * 100 AS change_pct FROM near WHERE rn = 1"),
)
def change_pct_nearest(spark, sf):
    return S.change_pct_window(daily_prices(spark, sf), ["series"], "date", "value", 30, pick="nearest")


@query(
    "panel_summary", "E2, E1",
    with_(OFFERS, DAILY, CHANGES, f"""SELECT series, count(*) AS valid_days, min(date) AS first_date, max(date) AS last_date,
  max(date) - min(date) + 1 AS span_days, count(*) >= 10 AS chart_ready, count(*) >= 20 AS inflection_eligible,
  count(*) >= 60 AS confirmed_90d_eligible, any_value({PCT30}) AS change_30d_pct, any_value({PCT90}) AS change_90d_pct
FROM daily JOIN changes USING (series) GROUP BY series"""),
)
def panel_summary(spark, sf):
    return S.panel_summary(daily_prices(spark, sf), ["series"], "date", "value")


@query(
    "trailing_mean_full", "E3",
    with_(USAGE, SHARES, """w AS (SELECT date, CAST(total_tokens AS DOUBLE) AS total, CAST(named_tokens AS DOUBLE) AS named FROM totals),
m AS (SELECT date, total, named, avg(total) OVER f AS average, avg(named) OVER f AS named_average, row_number() OVER (ORDER BY date) AS rn
  FROM w WINDOW f AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
          "SELECT date, total, named, average, named_average FROM m WHERE rn >= 4"),
)
def trailing_mean_full(spark, sf):
    named = F.coalesce(F.sum(F.when(F.col("model") != "Others", F.col("tokens"))), F.lit(0)).cast("double")
    weeks = usage(spark, sf).groupBy("date").agg(F.sum("tokens").cast("double").alias("total"), named.alias("named"))
    return S.trailing_mean_full(weeks, [], "date", {"total": "average", "named": "named_average"})


@query(
    "trailing_mean_partial", "E4",
    with_(OFFERS, DAILY, """SELECT date, series, value, avg(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
AS moving_average FROM daily"""),
)
def trailing_mean_partial(spark, sf):
    rows = daily_prices(spark, sf).select("date", "series", "value")
    return S.trailing_mean_partial(rows, ["series"], "date", "value")


@query(
    "rolling_median", "E5, C9",
    with_(OFFERS, DAILY, """ratios AS (SELECT a.date, a.series, a.value / b.value AS ratio FROM daily a JOIN daily b USING (date)
  WHERE a.series <> 'A' AND b.series = 'A' AND b.value <> 0)""",
          """SELECT date, series, ratio, median(ratio) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
AS rolling_median FROM ratios"""),
)
def rolling_median(spark, sf):
    ratios = J.ratio_to_base(daily_prices(spark, sf), "series", "date", "value", "A")
    return S.rolling_median(ratios, ["series"], "date", "ratio")


MODEL_MEANS = """m AS (SELECT date, model, tokens, avg(CAST(tokens AS DOUBLE)) OVER (PARTITION BY model ORDER BY date
    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS average, row_number() OVER (PARTITION BY model ORDER BY date) AS rn FROM usage)"""


@query(
    "ma_index", "E6",
    with_(USAGE, MODEL_MEANS, "k AS (SELECT * FROM m WHERE rn >= 4)",
          """SELECT date, model, tokens, average, average / first_value(average) OVER (PARTITION BY model ORDER BY date) * 100 AS index_value FROM k"""),
)
def ma_index(spark, sf):
    return S.ma_index(usage(spark, sf), ["model"], "date", "tokens")


@query(
    "lag_change_latest", "E7",
    with_(USAGE, """c AS (SELECT model, tokens, lag(tokens, 4) OVER (PARTITION BY model ORDER BY date) AS prior,
  row_number() OVER (PARTITION BY model ORDER BY date DESC) AS rn FROM usage)""",
          """SELECT model, CASE WHEN prior <> 0 THEN (CAST(tokens AS DOUBLE) / CAST(prior AS DOUBLE) - 1) * 100 END AS change_pct FROM c WHERE rn = 1"""),
)
def lag_change_latest(spark, sf):
    return S.lag_change_latest(usage(spark, sf), ["model"], "date", "tokens")


@query(
    "top_n_per_group", "E8",
    with_(USAGE, """SELECT date, model, tokens, rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY tokens DESC, model) AS rank
FROM usage WHERE model <> 'Others') WHERE rank <= 3"""),
)
def top_n_per_group(spark, sf):
    rows = usage(spark, sf).where("model <> 'Others'")
    return S.top_n_per_group(rows, ["date"], [F.desc("tokens"), F.asc("model")], 3)


@query(
    "ranks_with_residual", "E8",
    with_(USAGE, """SELECT date, model, tokens, row_number() OVER (PARTITION BY date ORDER BY (model = 'Others'), tokens DESC, model) AS rank FROM usage"""),
)
def ranks_with_residual(spark, sf):
    return S.ranks_with_residual(usage(spark, sf), "date", "model", "tokens")


@query(
    "latest_per_series", "E9",
    with_(OFFERS, """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, provider, model ORDER BY date DESC, seq DESC) AS rn FROM offers) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series, provider ORDER BY value, model) AS price_rank FROM latest)""",
          "SELECT series, provider, model, date, value FROM ranked WHERE price_rank = 1"),
)
def latest_per_series(spark, sf):
    from tidemark.operators.ordered import first_per_key, last_per_key

    latest = last_per_key(offers(spark, sf), ["series", "provider", "model"], ["date", "seq"])
    cheapest = first_per_key(latest, ["series", "provider"], ["value", "model"])
    return cheapest.select("series", "provider", "model", "date", "value")


EVENTS_SQL = """points AS (SELECT model, date, seq, value, lag(value) OVER (PARTITION BY model ORDER BY date, seq) AS prior FROM offers),
change_events AS (
  SELECT model, date, seq, CASE WHEN prior IS NULL THEN 'initial_observation' ELSE 'value_change' END AS event_type,
         prior AS prior_value, value, CASE WHEN prior <> 0 THEN (value / prior - 1) * 100 END AS change_pct
  FROM points WHERE prior IS NULL OR value <> prior)"""


@query("change_events", "E26", with_(OFFERS, EVENTS_SQL, "SELECT * FROM change_events"))
def change_events(spark, sf):
    return S.change_events(ledger(spark, sf), ["model"], "date", "seq", "value")


@query(
    "largest_event_per_key", "E10",
    with_(OFFERS, EVENTS_SQL, """ranked AS (SELECT model, date, change_pct, row_number() OVER (PARTITION BY model ORDER BY date DESC, abs(change_pct) DESC) AS rn
  FROM change_events WHERE abs(change_pct) >= 5)""", "SELECT model, date, change_pct FROM ranked WHERE rn = 1"),
)
def largest_event_per_key(spark, sf):
    events = S.change_events(ledger(spark, sf), ["model"], "date", "seq", "value")
    out = S.largest_event_per_key(events, [F.col("model")], "date", "change_pct")
    return out.select("model", "date", "change_pct")


@query(
    "leader_changes", "E11",
    with_(USAGE, """lead AS (SELECT date, model FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY tokens DESC, model) AS rn
  FROM usage WHERE model <> 'Others') WHERE rn = 1),
moved AS (SELECT model IS DISTINCT FROM lag(model) OVER (ORDER BY date) AS changed FROM lead)""",
          "SELECT count(*) AS periods, count(*) FILTER (WHERE changed) AS changes FROM moved"),
)
def leader_changes(spark, sf):
    return S.leader_changes(usage(spark, sf), "date", "model", "tokens")


@query(
    "decline_vs_prior", "E12",
    with_(ORDER_MODELS, QUARTERLY, """l AS (SELECT entity, value, lag(value) OVER (PARTITION BY entity ORDER BY date) AS prior FROM quarterly)""",
          "SELECT count(DISTINCT entity) AS declining FROM l WHERE value < prior"),
)
def decline_vs_prior(spark, sf):
    return S.decline_vs_prior(quarterly(spark, sf), ["entity"], "date", "value", "entity")


@query(
    "longest_consecutive_run", "E13",
    with_(ORDER_MODELS, QUARTERLY, STRONG, """steps AS (SELECT DISTINCT entity, fy * 4 + q AS o FROM strong),
islands AS (SELECT entity, o - row_number() OVER (PARTITION BY entity ORDER BY o) AS g FROM steps),
runs AS (SELECT entity, g, count(*) AS n FROM islands GROUP BY ALL)""",
          "SELECT entity, max(n) AS longest_run FROM runs GROUP BY entity"),
)
def longest_consecutive_run(spark, sf):
    return S.longest_consecutive_run(strong_quarters(spark, sf), ["entity"], F.col("fy") * 4 + F.col("q"))


@query(
    "latest_sequential_run", "E14",
    with_(ORDER_MODELS, QUARTERLY, STRONG, """g AS (SELECT entity, date, lag(date) OVER (PARTITION BY entity ORDER BY date DESC) - date AS gap FROM strong),
b AS (SELECT entity, sum(CASE WHEN gap IS NULL OR gap BETWEEN 80 AND 100 THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY date DESC) AS breaks FROM g)""",
          "SELECT entity, count(*) FILTER (WHERE breaks = 0) AS run FROM b GROUP BY entity"),
)
def latest_sequential_run(spark, sf):
    return S.latest_sequential_run(strong_quarters(spark, sf), ["entity"], "date")


FIRST_TWO = """weeks AS (SELECT date, CAST(sum(tokens) AS BIGINT) AS total FROM usage GROUP BY date),
placed AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, lead(total) OVER (ORDER BY date) AS nxt FROM weeks),
marked AS (SELECT date, total, rn = 1 AND nxt > 0 AND total < 0.5 * nxt AS is_partial FROM placed)"""


def _week_totals(spark, sf):
    return usage(spark, sf).groupBy("date").agg(F.sum("tokens").alias("total"))


@query("drop_partial_first", "E15", with_(USAGE, FIRST_TWO, "SELECT date, total FROM marked WHERE NOT coalesce(is_partial, false)"))
def drop_partial_first(spark, sf):
    return S.drop_partial_first(_week_totals(spark, sf), [], "date", "total")


@query(
    "complete_period_count", "E15",
    with_(USAGE, FIRST_TWO, "SELECT count(*) FILTER (WHERE NOT coalesce(is_partial, false)) AS complete_periods, max(date) FILTER (WHERE is_partial) AS dropped FROM marked"),
)
def complete_period_count(spark, sf):
    return S.complete_period_count(_week_totals(spark, sf), "date", "total")


@query(
    "composition_changes", "E16",
    with_(OFFERS, """counts AS (SELECT date, series, count(DISTINCT provider) AS n FROM offers GROUP BY ALL),
l AS (SELECT *, lag(n) OVER (PARTITION BY series ORDER BY date) AS p FROM counts)""",
          "SELECT series, date, p || '→' || n AS label FROM l WHERE n <> p"),
)
def composition_changes(spark, sf):
    counts = offers(spark, sf).groupBy("date", "series").agg(F.count_distinct("provider").alias("n"))
    return S.composition_changes(counts, ["series"], "date", "n")


HALVES = """recent AS (SELECT * FROM depth_days ORDER BY date DESC LIMIT 60),
placed AS (SELECT offers, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM recent),
growth AS (SELECT count(*) AS window_days, CASE WHEN count(*) >= 4 AND avg(offers) FILTER (WHERE rn <= greatest(1, n // 2)) > 0 THEN
  (avg(offers) FILTER (WHERE rn > greatest(1, n // 2)) / avg(offers) FILTER (WHERE rn <= greatest(1, n // 2)) - 1) * 100 END AS growth_pct FROM placed)"""


@query("half_window_growth", "E17", with_(DEPTH, DEPTH_DAYS, HALVES, "SELECT * FROM growth"))
def half_window_growth(spark, sf):
    return S.half_window_growth(daily_depth_totals(spark, sf), "date", "offers")


@query(
    "rebase_common_start", "E18",
    with_(OFFERS, PANEL, """starts AS (SELECT series, member, min(date) AS s FROM panel GROUP BY ALL),
common AS (SELECT series, max(s) AS common_start, count(*) AS n FROM starts GROUP BY series),
kept AS (SELECT p.*, common_start FROM panel p JOIN common USING (series) WHERE date >= common_start),
based AS (SELECT *, first_value(value) OVER (PARTITION BY series, member ORDER BY date) AS base FROM kept)""",
          "SELECT series, member, date, 100 * value / base AS value, common_start FROM based WHERE base <> 0"),
)
def rebase_common_start(spark, sf):
    return S.rebase_common_start(weekly_panel(spark, sf), ["series"], "member", "date", "value")


SUFFIX = """days AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS len FROM (SELECT DISTINCT series, date FROM panel)),
quotes AS (SELECT series, member, len FROM panel JOIN days USING (series, date)),
cover AS (SELECT d.series, d.len, q.member, count(*) AS c FROM days d JOIN quotes q ON d.series = q.series AND q.len <= d.len GROUP BY ALL),
good AS (SELECT series, len, count(*) AS members FROM cover WHERE c >= CAST(0.9 AS DOUBLE) * len AND len >= 10 GROUP BY ALL),
best AS (SELECT series, max(len) AS suffix_days FROM good WHERE members >= 3 GROUP BY series),
members AS (SELECT c.series, c.member, suffix_days FROM cover c JOIN best b ON c.series = b.series AND c.len = b.suffix_days
  WHERE c >= CAST(0.9 AS DOUBLE) * c.len),
inside AS (SELECT p.series, p.member, p.date, p.value, d.len, count(*) OVER (PARTITION BY p.series, p.date) AS quoting,
    (SELECT count(*) FROM members m2 WHERE m2.series = p.series) AS size
  FROM panel p JOIN members m USING (series, member) JOIN days d ON d.series = p.series AND d.date = p.date AND d.len <= m.suffix_days),
windows AS (SELECT series, max(len) AS w FROM inside WHERE quoting = size GROUP BY series HAVING max(len) >= 10),
win AS (SELECT i.* FROM inside i JOIN windows USING (series) WHERE len <= w),
means AS (SELECT series, date, sum(value) / count(*) AS mean_value, count(*) AS members FROM win WHERE quoting = size GROUP BY ALL)"""


@query("panel_members", "E19", with_(OFFERS, PANEL, SUFFIX, "SELECT * FROM members"))
def panel_members(spark, sf):
    return S.panel_members(weekly_panel(spark, sf), "series", "member", "date")


@query(
    "matched_panel_index", "E19",
    with_(OFFERS, PANEL, SUFFIX, """SELECT series, date, mean_value, members,
  100 * (mean_value / first_value(mean_value) OVER (PARTITION BY series ORDER BY date)) AS index_value FROM means"""),
)
def matched_panel_index(spark, sf):
    return S.matched_panel_index(weekly_panel(spark, sf), "series", "member", "date", "value")


@query(
    "jump_attribution", "E20",
    with_(OFFERS, PANEL, SUFFIX, """moves AS (SELECT series, member, date, value / lag(value) OVER (PARTITION BY series, member ORDER BY date) - 1 AS change
  FROM win WHERE quoting = size),
jumps AS (SELECT series, date, mean_value / lag(mean_value) OVER (PARTITION BY series ORDER BY date) - 1 AS panel_change FROM means),
ranked AS (SELECT series, date, panel_change, member AS mover, change AS mover_change,
    row_number() OVER (PARTITION BY series, date ORDER BY abs(change) DESC, member) AS rn
  FROM moves JOIN jumps USING (series, date) WHERE abs(panel_change) > CAST(0.05 AS DOUBLE) AND change IS NOT NULL)""",
          "SELECT series, date, panel_change, mover, mover_change FROM ranked WHERE rn = 1"),
)
def jump_attribution(spark, sf):
    rows = S.matched_panel_rows(weekly_panel(spark, sf), "series", "member", "date", "value")
    return S.jump_attribution(rows, "series", "member", "date", "value")


# A member's weekly quote is its quarter's median order, which stays level within a quarter and steps between them.
def _levels(spark, sf):
    from tidemark.catalog.adapters import _order_models, cents
    from tidemark.operators.ordered import group_median

    rows = _order_models(spark, sf).select(
        F.col("n_name").alias("panel"), F.col("c_mktsegment").alias("member"), F.trunc("o_orderdate", "quarter").alias("quarter"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("date"), cents("o_totalprice").alias("value"),
    )
    keys = ["panel", "member", "quarter"]
    medians = group_median(rows, keys, "value", "value")
    weeks = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"))
    # A week on the edge of two quarters is quoted at the later one.
    return weeks.join(medians, keys).groupBy("panel", "member", "date").agg(F.max_by("value", "quarter").alias("value"))


@query(
    "persistent_steps", "E21",
    with_("RECURSIVE " + ORDER_MODELS, """o AS (SELECT n_name AS panel, c_mktsegment AS member, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS date, floor(o_totalprice * 100 + 0.5) AS value FROM order_models JOIN customer ON o_custkey = c_custkey),
cells AS (SELECT panel, member, quarter, median(value) AS value FROM o GROUP BY ALL),
levels AS (SELECT panel, member, date, arg_max(c.value, quarter) AS value FROM (SELECT DISTINCT panel, member, quarter, date FROM o) JOIN cells c USING (panel, member, quarter) GROUP BY ALL),
p AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS prior, list(value) OVER (PARTITION BY panel, member ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS head,
  list(value) OVER (PARTITION BY panel, member ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS tail FROM levels WINDOW w AS (PARTITION BY panel, member ORDER BY date)),
c AS (SELECT panel, member, date, i, value / prior - 1 AS change FROM p WHERE prior > 0 AND abs(value / prior - 1) >= 0.2 AND len(head) = 3 AND len(tail) = 5
  AND len(list_filter(head, lambda x: abs(x / prior - 1) > 0.1)) = 0 AND len(list_filter(tail, lambda x: abs(x / value - 1) > 0.1)) = 0),
n AS (SELECT a.panel, a.member, a.i, min(b.i) AS next FROM c a LEFT JOIN c b ON a.panel = b.panel AND a.member = b.member AND b.i >= a.i + 6 GROUP BY ALL),
walk AS (SELECT panel, member, min(i) AS i FROM c GROUP BY ALL UNION ALL
  SELECT w.panel, w.member, n.next FROM walk w JOIN n ON w.panel = n.panel AND w.member = n.member AND w.i = n.i WHERE n.next IS NOT NULL)""",
          "SELECT panel, member, date, change FROM c JOIN walk USING (panel, member, i)"),
)
def persistent_steps(spark, sf):
    return S.persistent_steps(_levels(spark, sf), "panel", "member", "date", "value")


RECENT_CUTS = """win90 AS (SELECT model, value, lag(value) OVER (PARTITION BY model ORDER BY date, seq) AS prior
  FROM offers WHERE date >= DATE '2001-08-01' - 90 AND value IS NOT NULL)"""


@query("recent_cuts", "E22", with_(OFFERS, RECENT_CUTS, "SELECT DISTINCT model FROM win90 WHERE value < prior"))
def recent_cuts(spark, sf):
    return S.recent_cuts(ledger(spark, sf), ["model"], "date", "seq", "value", day("2001-08-01"))


#: The same among the points that state a second price as well.
CUTS = PRICED_LEDGER + """,
win90 AS (SELECT model, value, lag(value) OVER (PARTITION BY model ORDER BY date, seq) AS prior
  FROM priced_ledger WHERE date >= DATE '2001-08-01' - 90 AND value IS NOT NULL AND output IS NOT NULL),
cut_models AS (SELECT DISTINCT model FROM win90 WHERE value < prior)"""


@query(
    "k_back_change", "E23",
    with_(OFFERS, DAILY, "r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS rn FROM daily)",
          """SELECT a.series, CASE WHEN b.value > 0 THEN (a.value / b.value - 1) * 100 END AS change_pct FROM r a
LEFT JOIN r b ON a.series = b.series AND b.rn = 29 WHERE a.rn = 1"""),
)
def k_back_change(spark, sf):
    return S.k_back_change(daily_prices(spark, sf), ["series"], "date", "value", 4)


@query(
    "segment_gaps", "E24",
    with_(ACTIVITY, """d AS (SELECT DISTINCT user_id, date FROM activity),
o AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY user_id ORDER BY date) > 1 THEN 1 ELSE 0 END AS opens FROM d)""",
          "SELECT user_id, date, CAST(1 + sum(opens) OVER (PARTITION BY user_id ORDER BY date) AS BIGINT) AS segment FROM o"),
)
def segment_gaps(spark, sf):
    return S.segment_gaps(activity(spark, sf).select("user_id", "date").distinct(), ["user_id"], "date", 1)


@query(
    "collection_gaps", "E25",
    with_(DEPTH, """span AS (SELECT source, min(date) AS lo, max(date) AS hi FROM depth GROUP BY source),
grid AS (SELECT source, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS missing_date FROM span)""",
          "SELECT source, missing_date FROM grid g WHERE NOT EXISTS (SELECT 1 FROM depth d WHERE d.source = g.source AND d.date = g.missing_date)"),
)
def collection_gaps(spark, sf):
    return S.collection_gaps(depth(spark, sf), ["source"], "date")


@query(
    "collection_coverage", "E25",
    with_(DEPTH, """SELECT source, count(DISTINCT date) AS valid_days, max(date) - min(date) + 1 AS span_days,
  count(DISTINCT date) / (max(date) - min(date) + 1) * 100 AS coverage_pct FROM depth GROUP BY source"""),
)
def collection_coverage(spark, sf):
    return S.collection_coverage(depth(spark, sf), ["source"], "date")


@query(
    "window_floor", "E27",
    with_(OFFERS, DEPTH, "SELECT date, source, offers FROM depth WHERE date >= (SELECT min(date) FROM offers)"),
)
def window_floor(spark, sf):
    return S.window_floor(depth(spark, sf), "date", offers(spark, sf), "date")


@query(
    "growth_multiple", "E28, E15",
    with_(USAGE, """placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date) AS rn, lead(tokens) OVER (PARTITION BY model ORDER BY date) AS nxt FROM usage),
kept AS (SELECT * FROM placed WHERE NOT coalesce(rn = 1 AND nxt > 0 AND tokens < 0.5 * nxt, false))""",
          """SELECT model, min(date) AS base_date, CAST(arg_max(tokens, date) AS DOUBLE) / CAST(arg_min(tokens, date) AS DOUBLE) AS multiple FROM kept GROUP BY model"""),
)
def growth_multiple(spark, sf):
    return S.growth_multiple(usage(spark, sf), ["model"], "date", "tokens")


@query(
    "first_last_change", "E29",
    with_(OFFERS, DAILY, """e AS (SELECT series, count(*) AS n, arg_min(value, date) AS first_value, arg_max(value, date) AS last_value FROM daily GROUP BY series)""",
          """SELECT series, first_value, last_value, CASE WHEN n >= 2 AND first_value <> 0 THEN (last_value / first_value - 1) * 100 END AS change_pct,
  CASE WHEN n >= 2 THEN CASE WHEN last_value > first_value THEN 'rising' WHEN last_value < first_value THEN 'falling' ELSE 'flat' END END AS direction FROM e"""),
)
def first_last_change(spark, sf):
    return S.first_last_change(daily_prices(spark, sf), ["series"], "date", "value")


@query(
    "base100", "E30",
    with_(OFFERS, DAILY, """SELECT date, series, value, value / first_value(value) OVER (PARTITION BY series ORDER BY date) * 100 AS index_value FROM daily"""),
)
def base100(spark, sf):
    rows = daily_prices(spark, sf).select("date", "series", "value")
    return S.base100(rows, ["series"], "date", "value")


@query(
    "top_series_history", "E30",
    with_(USAGE, """leaders AS (SELECT model FROM usage WHERE date = (SELECT max(date) FROM usage) AND model <> 'Others' ORDER BY tokens DESC, model LIMIT 5)""",
          "SELECT * FROM usage SEMI JOIN leaders USING (model)"),
)
def top_series_history(spark, sf):
    return S.top_series_history(usage(spark, sf), "model", "date", "tokens").select("date", "model", "tokens")


@query(
    "indicator_accumulation", "E31",
    with_(OFFERS, DAILY, """SELECT series, value AS latest_value, (SELECT count(DISTINCT date) FROM daily) AS days,
  least(1.0::DOUBLE, (SELECT count(DISTINCT date) FROM daily) / 10) AS progress FROM daily WHERE date = (SELECT max(date) FROM daily)"""),
)
def indicator_accumulation(spark, sf):
    return S.indicator_accumulation(daily_prices(spark, sf), "series", "date", "value")


@query(
    "gap_range", "E32",
    with_(DEPTH, """d AS (SELECT source, date, date - lag(date) OVER (PARTITION BY source ORDER BY date) AS gap FROM depth)""",
          "SELECT source, min(gap) AS min_gap, max(gap) AS max_gap, max(date) - min(date) AS span_days FROM d GROUP BY source"),
)
def gap_range(spark, sf):
    return S.gap_range(depth(spark, sf), ["source"], "date")
