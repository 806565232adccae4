"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.catalog.adapters import (
    ACTIVITY, DAILY, DEPTH, DEPTH_DAYS, OFFERS, PRICED, QUARTERLY, ORDER_MODELS, USAGE, USAGE_LEDGER,
    activity, cents, daily_prices, day, depth, ledger, offers, priced_usage, quarterly, table, usage,
)
from tidemark.catalog.registry import query, with_
from tidemark.operators import aggregates as A

EXCLUSIVE = "list_sort(list(vote)) AS v, count(*) AS n"


def _exclusive(p: float) -> str:
    """SQL of the rank-p(n+1) quantile over a sorted list ``v`` of length ``n``."""
    j = f"CAST(greatest(1, least(floor({p} * (n + 1)), n - 1)) AS BIGINT)"
    f = f"({p} * (n + 1) - {j})"
    return f"v[{j}] * (1 - {f}) + v[{j} + 1] * {f}"


@query(
    "two_level_median", "D1",
    with_(OFFERS, DAILY, f"lists AS (SELECT date, series, {EXCLUSIVE} FROM votes GROUP BY ALL)",
          f"""SELECT date, series, d.value, d.low, d.high, d.average, entity_count, entity_count % 2 = 0 AS synthetic,
       CASE WHEN n >= 4 THEN {_exclusive(0.25)} END AS p25,
       CASE WHEN n >= 4 THEN {_exclusive(0.75)} END AS p75
FROM daily d JOIN lists USING (date, series)"""),
)
def two_level_median(spark, sf):
    return daily_prices(spark, sf)


@query(
    "entity_medians", "D1",
    with_(OFFERS, "SELECT date, series, provider, median(value) AS median FROM offers GROUP BY ALL"),
)
def entity_medians(spark, sf):
    return A.entity_medians(offers(spark, sf), ["date", "series"], "provider", "value")


@query(
    "pooled_median", "D2",
    with_(OFFERS, "SELECT date, series, median(value) AS value FROM offers GROUP BY ALL"),
)
def pooled_median(spark, sf):
    return A.pooled_median(offers(spark, sf), ["date", "series"], "value")


@query(
    "pooled_median_hot_series", "D2",
    with_(OFFERS, "SELECT series, median(value) AS value FROM offers GROUP BY ALL"),
)
def pooled_median_hot_series(spark, sf):
    return A.pooled_median(offers(spark, sf), ["series"], "value")


@query(
    "quartiles_exclusive", "D3",
    with_(OFFERS, "lists AS (SELECT date, series, list_sort(list(value)) AS v, count(*) AS n, median(value) AS p50 FROM offers GROUP BY ALL)",
          f"""SELECT date, series, n, p50, CASE WHEN n >= 4 THEN {_exclusive(0.25)} ELSE p50 END AS p25,
       CASE WHEN n >= 4 THEN {_exclusive(0.75)} ELSE p50 END AS p75 FROM lists"""),
)
def quartiles_exclusive(spark, sf):
    return A.quartiles_exclusive(offers(spark, sf), ["date", "series"], "value")


@query(
    "quartiles_exclusive_or_null", "D3",
    with_(OFFERS, "lists AS (SELECT date, series, list_sort(list(value)) AS v, count(*) AS n, median(value) AS p50 FROM offers GROUP BY ALL)",
          f"""SELECT date, series, n, p50, CASE WHEN n >= 4 THEN {_exclusive(0.25)} END AS p25,
       CASE WHEN n >= 4 THEN {_exclusive(0.75)} END AS p75 FROM lists"""),
)
def quartiles_exclusive_or_null(spark, sf):
    return A.quartiles_exclusive(offers(spark, sf), ["date", "series"], "value", below_four="null")


@query(
    "book_summary", "D4",
    with_(OFFERS, """lists AS (
  SELECT date, series, list_sort(list(value)) AS v, count(*) AS n, median(value) AS p50, min(value) AS lo,
         max(value) AS hi, CAST(sum(gpus) AS BIGINT) AS gpu_count_total, count(DISTINCT provider) AS provider_count,
         CAST(max(gpus) AS BIGINT) AS server_total FROM offers GROUP BY ALL)""",
          f"""SELECT date, series, n AS offer_count, lo AS min_price, hi AS max_price, p50 AS median_price,
       CASE WHEN n >= 4 THEN {_exclusive(0.25)} ELSE p50 END AS p25_price,
       CASE WHEN n >= 4 THEN {_exclusive(0.75)} ELSE p50 END AS p75_price,
       gpu_count_total, provider_count, server_total, server_total > n AS truncated FROM lists"""),
)
def book_summary(spark, sf):
    return A.book_summary(offers(spark, sf), ["date", "series"], "value", "gpus", "provider", "gpus")


@query(
    "daily_depth", "D5",
    with_(DEPTH, DEPTH_DAYS, "SELECT count(*) AS valid_dates, arg_max(offers, date) AS latest_total FROM depth_days"),
)
def daily_depth(spark, sf):
    return A.daily_depth(depth(spark, sf), "date", "offers")


@query(
    "depth_by_source", "D6",
    with_(DEPTH, "SELECT date, source, CAST(sum(offers) AS BIGINT) AS offers FROM depth GROUP BY ALL"),
)
def depth_by_source(spark, sf):
    return A.depth_by_source(depth(spark, sf), "date", "source", "offers")


@query(
    "capacity_total", "D7",
    with_(OFFERS, "days AS (SELECT date, CAST(sum(gpus) AS BIGINT) AS gpus FROM offers GROUP BY date)",
          "SELECT arg_max(gpus, date) AS latest_total FROM days"),
)
def capacity_total(spark, sf):
    return A.latest_total(offers(spark, sf), "date", "gpus")


@query(
    "coverage_counts", "D8",
    with_(OFFERS, "SELECT count(*) AS rows, count(DISTINCT provider) AS providers FROM offers"),
)
def coverage_counts(spark, sf):
    return A.coverage_counts(offers(spark, sf), "provider")


def _stock(spark, sf):
    """Availability cells: open cents of the day by priority against all of them."""
    open_cents = F.when(F.col("o_orderstatus") == "O", cents("o_totalprice"))
    return table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("provider"),
        F.coalesce(open_cents, F.lit(0)).cast("long").alias("available"),
        F.when(F.col("o_orderstatus") != "P", cents("o_totalprice")).cast("long").alias("total"),
    )


STOCK = """stock AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS provider,
         CAST(CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice * 100 + 0.5) ELSE 0 END AS BIGINT) AS available,
         CAST(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice * 100 + 0.5) END AS BIGINT) AS total FROM orders)"""


@query(
    "availability_pct", "D9",
    with_(STOCK, """SELECT date, 100 * CAST(sum(available) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS availability_pct
FROM stock WHERE total > 0 GROUP BY date"""),
)
def availability_pct(spark, sf):
    return A.availability_pct(_stock(spark, sf), ["date"], "available", "total")


@query(
    "breadth", "D10",
    with_(STOCK, "SELECT date, nullif(count(DISTINCT CASE WHEN total > 0 THEN provider END), 0) AS breadth FROM stock GROUP BY date"),
)
def breadth(spark, sf):
    return A.breadth(_stock(spark, sf), ["date"], "provider", "total")


SHARES = """totals AS (
  SELECT date, CAST(sum(tokens) AS BIGINT) AS total_tokens,
         CAST(coalesce(sum(tokens) FILTER (WHERE model <> 'Others'), 0) AS BIGINT) AS named_tokens,
         CAST(coalesce(sum(tokens) FILTER (WHERE model = 'Others'), 0) AS BIGINT) AS rest FROM usage GROUP BY date),
shares AS (
  SELECT date, model, tokens, total_tokens, named_tokens,
         CAST(tokens AS DOUBLE) / CAST(total_tokens AS DOUBLE) * 100 AS share_pct
  FROM usage JOIN totals USING (date))"""


@query("weekly_shares", "D11", with_(USAGE, SHARES, "SELECT * FROM shares"))
def weekly_shares(spark, sf):
    return A.weekly_shares(usage(spark, sf), "date", "model", "tokens")


@query(
    "weekly_residual", "D11",
    with_(USAGE, SHARES, """SELECT date, model, CAST(tokens AS DOUBLE) AS tokens FROM usage WHERE model <> 'Others'
UNION ALL SELECT date, 'Others', greatest(0, CAST(total_tokens - named_tokens AS DOUBLE)) FROM totals"""),
)
def weekly_residual(spark, sf):
    rows = usage(spark, sf)
    totals = rows.groupBy("date").agg(F.sum("tokens").alias("total"))
    return A.with_residual(rows.where("model <> 'Others'"), totals, "date", "model", "tokens", "total")


@query(
    "disclosure", "D11",
    with_(USAGE, SHARES, """SELECT date, total_tokens, CAST(rest AS DOUBLE) / CAST(total_tokens AS DOUBLE) * 100 AS others_share,
       CAST(total_tokens - rest AS DOUBLE) / CAST(total_tokens AS DOUBLE) * 100 AS named_share FROM totals"""),
)
def disclosure(spark, sf):
    return A.disclosure(usage(spark, sf), "date", "model", "tokens")


@query(
    "provider_shares", "D12",
    with_(USAGE, SHARES, """SELECT date, provider, CAST(sum(tokens) AS BIGINT) AS tokens,
       CAST(sum(tokens) AS DOUBLE) / CAST(any_value(total_tokens) AS DOUBLE) * 100 AS share_pct
FROM (SELECT date, CASE WHEN model = 'Others' THEN 'Others' ELSE split_part(model, '/', 1) END AS provider, tokens FROM usage
      UNION ALL SELECT DISTINCT date, 'Others', 0 FROM usage) JOIN totals USING (date) GROUP BY date, provider"""),
)
def provider_shares(spark, sf):
    return A.provider_shares(usage(spark, sf), "date", "model", "tokens")


@query(
    "weighted_price", "D13",
    with_(USAGE, USAGE_LEDGER, PRICED, """SELECT date,
       round(sum(tokens * price) / sum(tokens) FILTER (WHERE price IS NOT NULL), 6) AS weighted_price,
       CAST(sum(tokens) FILTER (WHERE price IS NOT NULL) AS DOUBLE) / CAST(sum(tokens) AS DOUBLE) * 100 AS coverage_pct,
       CAST(coalesce(sum(tokens) FILTER (WHERE price IS NOT NULL AND model <> 'Others'), 0) AS DOUBLE)
         / CAST(sum(tokens) FILTER (WHERE model <> 'Others') AS DOUBLE) * 100 AS named_coverage_pct
FROM priced GROUP BY date"""),
)
def weighted_price(spark, sf):
    out = A.weighted_price(priced_usage(spark, sf), "date", "tokens", "price", F.col("model") != "Others")
    return out.withColumn("weighted_price", F.round("weighted_price", 6))


TIERED = """tiers AS (
  SELECT date, tier, CAST(coalesce(sum(tokens), 0) AS DOUBLE) AS tokens
  FROM (SELECT DISTINCT date FROM usage) d
  CROSS JOIN (VALUES ('free'), ('under_1'), ('1_to_5'), ('over_5'), ('unmatched')) AS t(tier)
  LEFT JOIN (SELECT date, tokens, CASE WHEN price IS NULL THEN 'unmatched' WHEN price = 0 THEN 'free' WHEN price < 1 THEN 'under_1'
                    WHEN price <= 5 THEN '1_to_5' ELSE 'over_5' END AS tier FROM priced) p USING (date, tier)
  GROUP BY ALL),
tier_shares AS (
  SELECT date, tier, tokens / sum(tokens) OVER (PARTITION BY date) * 100 AS share_pct FROM tiers)"""


@query("tier_share", "D14, B9", with_(USAGE, USAGE_LEDGER, PRICED, TIERED, "SELECT * FROM tier_shares"))
def tier_share(spark, sf):
    return A.tier_share(priced_usage(spark, sf), "date", "tokens", "price", config.PRICE_TIERS)


@query(
    "unmatched_share", "D32",
    with_(USAGE, USAGE_LEDGER, PRICED, TIERED, """SELECT max(date) AS date,
       round(sum(share_pct) FILTER (WHERE tier = 'unmatched') / sum(share_pct) * 100, 6) AS unmatched_pct
FROM tier_shares WHERE date = (SELECT max(date) FROM tier_shares)"""),
)
def unmatched_share(spark, sf):
    tiers = A.tier_share(priced_usage(spark, sf), "date", "tokens", "price", config.PRICE_TIERS)
    out = A.unmatched_share(tiers, "date", "tier", "share_pct")
    return out.withColumn("unmatched_pct", F.round("unmatched_pct", 6))


@query(
    "conditional_medians", "D15",
    with_(OFFERS, """SELECT date, series, median(CASE WHEN kind = 'O' THEN value END) AS open_price,
       median(CASE WHEN kind IN ('F', 'O') THEN value END) AS any_price FROM offers GROUP BY date, series"""),
)
def conditional_medians(spark, sf):
    outputs = {"open_price": ["O"], "any_price": ["F", "O"]}
    return A.conditional_medians(offers(spark, sf), ["date", "series"], "kind", "value", outputs)


@query(
    "comparable_pooled_median", "D2, B22",
    with_(OFFERS, "SELECT date, series, median(value) AS value FROM offers WHERE series IN ('A', 'N') AND kind = 'O' AND value > 0 GROUP BY date, series"),
)
def comparable_pooled_median(spark, sf):
    rows = A.comparable_offers(offers(spark, sf), "series", "kind", "value", ["A", "N"], ["o"])
    return A.pooled_median(rows, ["date", "series"], "value")


@query(
    "conditional_extremes", "D16",
    with_(OFFERS, """SELECT date, series, min(CASE WHEN kind IN ('F', 'O') THEN value END) AS price,
       max(CASE WHEN kind = 'O' THEN value END) AS offers FROM offers GROUP BY date, series"""),
)
def conditional_extremes(spark, sf):
    return A.conditional_extremes(offers(spark, sf), ["date", "series"], "kind", "value", ["F", "O"], ["O"])


@query(
    "first_last", "D17",
    with_(DEPTH, """SELECT source, count(*) AS valid_dates, min(date) AS first_date, max(date) AS last_date,
       arg_min(v, date) AS first_value, arg_max(v, date) AS last_value
FROM (SELECT *, CASE WHEN offers > 1 THEN offers END AS v FROM depth) GROUP BY source"""),
)
def first_last(spark, sf):
    rows = depth(spark, sf).withColumn("v", F.when(F.col("offers") > 1, F.col("offers")))
    return A.first_last(rows, ["source"], "date", "v")


@query(
    "revision_counts", "D18",
    with_(ACTIVITY, """SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'signup') AS public_series,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase' AND value - 1000 > 0) AS positive_revisions,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase' AND value - 1000 < 0) AS negative_revisions,
       max(date) AS latest_event_date FROM activity"""),
)
def revision_counts(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "initial_observation").when(
        F.col("event_type") == "purchase", "value_change"
    )
    rows = activity(spark, sf).withColumn("kind", kind).withColumn("change", F.col("value") - 1000)
    return A.revision_counts(rows, "user_id", "kind", "change", "date")


@query(
    "any_flag", "D18",
    with_(ACTIVITY, "SELECT user_id, bool_or(event_type = 'error') AS had_error FROM activity GROUP BY user_id"),
)
def any_flag(spark, sf):
    return A.any_flag(activity(spark, sf), ["user_id"], F.col("event_type") == "error", "had_error")


@query(
    "distinct_text", "D19",
    with_(ACTIVITY, "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS codes FROM activity GROUP BY user_id"),
)
def distinct_text(spark, sf):
    return A.distinct_text(activity(spark, sf), ["user_id"], "event_type", "codes")


@query(
    "quartiles_inclusive", "D20",
    with_(OFFERS, """SELECT series, provider, quantile_cont(value, 0.25) AS p25, median(value) AS p50,
       quantile_cont(value, 0.75) AS p75 FROM offers GROUP BY series, provider"""),
)
def quartiles_inclusive(spark, sf):
    return A.quartiles_inclusive(offers(spark, sf), ["series", "provider"], "value")


@query(
    "having_distinct", "D21",
    with_(OFFERS, """SELECT model, provider, count(DISTINCT date) AS days, max(date) AS latest FROM offers
GROUP BY model, provider HAVING count(DISTINCT date) >= 2"""),
)
def having_distinct(spark, sf):
    return A.having_distinct(offers(spark, sf), ["model", "provider"], "date", 2, "date")


@query(
    "grouped_counts", "D21",
    with_(OFFERS, "SELECT series, kind, count(*) AS n FROM offers GROUP BY series, kind"),
)
def grouped_counts(spark, sf):
    return A.grouped_counts(offers(spark, sf), ["series", "kind"])


@query(
    "coverage_top", "D22",
    with_(USAGE, """stats AS (
  SELECT model, count(*) AS days, CAST(sum(tokens) AS BIGINT) AS total,
         CAST(coalesce(sum(tokens) FILTER (WHERE date = (SELECT max(date) FROM usage)), 0) AS BIGINT) AS latest
  FROM usage GROUP BY model)""",
          """SELECT * FROM stats WHERE days >= greatest(2, (SELECT max(days) FROM stats) - 1)
ORDER BY days DESC, total DESC, latest DESC, model LIMIT 8"""),
)
def coverage_top(spark, sf):
    return A.coverage_top(usage(spark, sf), "model", "date", "tokens")


@query(
    "cumulative_head", "D23",
    with_(USAGE, """recent AS (SELECT * FROM usage WHERE date IN (SELECT DISTINCT date FROM usage ORDER BY date DESC LIMIT 4)),
sums AS (SELECT model, sum(tokens) AS tokens FROM recent WHERE model <> 'Others' GROUP BY model),
ranked AS (SELECT model, tokens, row_number() OVER (ORDER BY tokens DESC, model) AS rank,
  coalesce(sum(tokens) OVER (ORDER BY tokens DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums)""",
          """SELECT rank, model, CAST(tokens AS BIGINT) AS tokens,
       CAST(tokens AS DOUBLE) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM recent) * 100 AS share_pct FROM ranked
WHERE rank <= 12 AND (rank = 1 OR CAST(before AS DOUBLE) < CAST((SELECT sum(tokens) FROM sums) AS DOUBLE) * CAST(0.8 AS DOUBLE))"""),
)
def cumulative_head(spark, sf):
    return A.cumulative_head(usage(spark, sf), "model", "date", "tokens")


@query(
    "change_point_counts", "D24",
    with_(OFFERS, """SELECT model, count(*) FILTER (WHERE date >= DATE '2001-08-01' - 28) AS recent, count(*) AS total
FROM offers GROUP BY model"""),
)
def change_point_counts(spark, sf):
    return A.change_point_counts(ledger(spark, sf), "model", "date", day("2001-08-01"))


@query(
    "concentration_hhi", "D25",
    with_(USAGE, SHARES, """SELECT round(sum(pow(share_pct / 100, 2)) * 10000, 4) AS hhi FROM shares
WHERE date = (SELECT max(date) FROM shares)"""),
)
def concentration_hhi(spark, sf):
    shares = A.weekly_shares(usage(spark, sf), "date", "model", "tokens")
    return A.concentration_hhi(shares, "date", "share_pct").withColumn("hhi", F.round("hhi", 4))


@query(
    "pearson", "D26",
    with_(USAGE, """pairs AS (SELECT a.model, a.tokens AS x, b.tokens AS y FROM usage a JOIN usage b
  ON a.date = b.date WHERE b.model = 'Others' AND a.model <> 'Others')""",
          """SELECT model, count(*) AS pairs, round(CASE WHEN count(*) < 5 THEN NULL
       WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 6) AS r FROM pairs GROUP BY model"""),
)
def pearson(spark, sf):
    rows = usage(spark, sf)
    others = rows.where("model = 'Others'").select("date", F.col("tokens").alias("y"))
    pairs = rows.where("model <> 'Others'").join(others, "date").withColumnRenamed("tokens", "x")
    return A.pearson(pairs, ["model"], "x", "y").withColumn("r", F.round("r", 6))


@query(
    "range_stats", "D27",
    with_(OFFERS, DAILY, "SELECT series, min(value) AS lo, max(value) AS hi, count(*) AS n, arg_max(value, date) AS last FROM daily GROUP BY series"),
)
def range_stats(spark, sf):
    return A.range_stats(daily_prices(spark, sf), ["series"], "date", "value")


@query(
    "proxy_stats", "D28",
    with_(OFFERS, "SELECT provider, median(value) AS median, count(*) AS rows, min(value) AS low FROM offers GROUP BY provider"),
)
def proxy_stats(spark, sf):
    return A.proxy_stats(offers(spark, sf), ["provider"], "value")


@query(
    "date_bounds", "D29",
    with_(OFFERS, DEPTH, ACTIVITY, """SELECT min(d) AS min_date, max(d) AS max_date FROM (
  SELECT date AS d FROM offers UNION ALL SELECT date FROM depth UNION ALL SELECT date FROM activity)"""),
)
def date_bounds(spark, sf):
    return A.date_bounds([(offers(spark, sf), "date"), (depth(spark, sf), "date"), (activity(spark, sf), "date")])


@query(
    "series_aggregates", "D30",
    with_(OFFERS, "SELECT date, series, CAST(sum(gpus) AS BIGINT) AS gpus, min(value) AS low FROM offers WHERE value > 0 GROUP BY date, series"),
)
def series_aggregates(spark, sf):
    rows = offers(spark, sf).where("value > 0")
    return rows.groupBy("date", "series").agg(F.sum("gpus").alias("gpus"), F.min("value").alias("low"))


@query(
    "source_divergence", "D31",
    with_(OFFERS, DAILY, """last_values AS (SELECT series, arg_max(value, date) AS v FROM daily GROUP BY series)""",
          "SELECT CASE WHEN count(*) >= 2 THEN max(v) - min(v) END AS divergence FROM last_values"),
)
def source_divergence(spark, sf):
    return A.source_divergence(daily_prices(spark, sf), "series", "date", "value")


@query(
    "quarterly_totals", "D30",
    with_(ORDER_MODELS, QUARTERLY, "SELECT * FROM quarterly"),
)
def quarterly_totals(spark, sf):
    return quarterly(spark, sf)
