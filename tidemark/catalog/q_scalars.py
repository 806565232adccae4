"""Projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.catalog.adapters import ACTIVITY, DAILY, OFFERS, QUARTERLY, ORDER_MODELS, activity, daily_prices, day, offers, quarterly, table
from tidemark.catalog.registry import query, with_
from tidemark.functions import scalars as S


def _case(column: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN contains({column}, '{n}') THEN '{v}'" for n, v in rules)
    return f"CASE {whens} ELSE {default} END"


# Part descriptions double as product texts: a family code is put where the brand number points.
PRODUCT_SQL = """products AS (
  SELECT p_partkey, p_brand, p_type || '_' || (list_value('RTX_5090', 'mi300x', 'GH200', 'b300-sxm', 'B200', 'h200', 'H100-80GB', 'a100',
      'pro_6000', 'mi325', 'l40s', 'other'))[1 + CAST(substr(p_brand, 7) AS INTEGER) % 12] AS text FROM part)"""


def _products(spark, sf):
    codes = [
        "RTX_5090", "mi300x", "GH200", "b300-sxm", "B200", "h200", "H100-80GB", "a100", "pro_6000", "mi325", "l40s", "other",
    ]
    number = F.substring("p_brand", 7, 3).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), number % 12 + 1)
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.concat_ws("_", "p_type", code).alias("text"))


@query(
    "classify_first_match", "B1",
    with_(PRODUCT_SQL, "folded AS (SELECT *, translate(lower(text), '_-', '  ') AS t, lower(text) AS raw FROM products)",
          f"""SELECT p_partkey, {_case('raw', config.FAMILY_RULES_FRONTIER, 'text')} AS frontier,
       {_case('t', config.FAMILY_RULES_ORDER_BOOK, "'unknown'")} AS order_book,
       {_case('t', config.FAMILY_RULES_PROVIDER, 'text')} AS provider FROM folded"""),
)
def classify_first_match(spark, sf):
    return _products(spark, sf).select(
        "p_partkey",
        S.classify_first_match("text", config.FAMILY_RULES_FRONTIER, fold_separators=False).alias("frontier"),
        S.classify_first_match("text", config.FAMILY_RULES_ORDER_BOOK, "unknown").alias("order_book"),
        S.classify_first_match("text", config.FAMILY_RULES_PROVIDER).alias("provider"),
    )


@query(
    "positive_or_null", "B2",
    """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance,
       CASE WHEN TRY_CAST(substr(s_name, 10) AS DOUBLE) > 0 THEN TRY_CAST(substr(s_name, 10) AS DOUBLE) END AS number,
       CASE WHEN TRY_CAST(s_name AS DOUBLE) > 0 THEN TRY_CAST(s_name AS DOUBLE) END AS text FROM supplier""",
)
def positive_or_null(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        S.positive("s_acctbal").alias("balance"),
        S.positive(F.substring("s_name", 10, 20)).alias("number"),
        S.positive("s_name").alias("text"),
    )


@query(
    "finite_or_null", "B3",
    """SELECT p_partkey, TRY_CAST(p_retailprice AS DOUBLE) AS price, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS number,
       CAST(NULL AS DOUBLE) AS ratio FROM part""",
)
def finite_or_null(spark, sf):
    infinite = F.when(F.col("p_size") >= 0, F.lit("Infinity")).otherwise("NaN")
    return table(spark, sf, "part").select(
        "p_partkey",
        S.finite("p_retailprice").alias("price"),
        S.finite(F.substring("p_brand", 7, 3)).alias("number"),
        S.finite(infinite).alias("ratio"),
    )


@query(
    "parse_day", "B4",
    """SELECT event_id, CAST(ts AS DATE) AS strict_day, strftime(ts, '%Y-%m-%d') AS cut_day, CAST(NULL AS DATE) AS bad_day FROM events""",
)
def parse_day(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id", S.parse_day(text).alias("strict_day"), S.day_of(text).alias("cut_day"), S.parse_day("event_type").alias("bad_day")
    )


@query("per_million", "B5", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal * 1000000 END AS scaled FROM supplier")
def per_million(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.per_million("s_acctbal").alias("scaled"))


NAMES_SQL = """names AS (
  SELECT p_partkey, p_type || '/' || replace(p_name, ' ', '-') || CASE WHEN p_size < 10 THEN '-preview' WHEN p_size < 20 THEN '-instruct'
      WHEN p_size < 30 THEN '-20250101' WHEN p_size < 40 THEN '-2025-01-01' ELSE '' END AS name FROM part)"""


def _names(spark, sf):
    suffix = (
        F.when(F.col("p_size") < 10, "-preview").when(F.col("p_size") < 20, "-instruct")
        .when(F.col("p_size") < 30, "-20250101").when(F.col("p_size") < 40, "-2025-01-01").otherwise("")
    )
    name = F.concat(F.col("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), suffix)
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


@query(
    "short_name", "B6",
    with_(NAMES_SQL, """cleaned AS (SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(
    regexp_extract(name, '[^/]*$'), '-preview', ''), '-instruct', ''), '-20\\d{6,8}$', ''), '-\\d{4}-\\d{2}-\\d{2}$', '') AS t FROM names)""",
          "SELECT p_partkey, CASE WHEN length(t) > 10 THEN substr(t, 1, 9) || '...' ELSE t END AS short FROM cleaned"),
)
def short_name(spark, sf):
    return _names(spark, sf).select("p_partkey", S.short_name("name", 10).alias("short"))


@query(
    "name_candidates", "B7",
    with_(NAMES_SQL, """parts AS (SELECT p_partkey, name AS raw, split_part(name, ':', 1) AS base,
    regexp_replace(split_part(name, ':', 1), '-20\\d{6}$', '') AS undated FROM names),
keys AS (SELECT p_partkey, unnest(list_value('openrouter/' || raw, 'openrouter/' || base, 'openrouter/' || undated, raw, base, undated,
    substr(undated, strpos(undated, '/') + 1))) AS key FROM parts)""",
          "SELECT DISTINCT p_partkey, key FROM keys"),
)
def name_candidates(spark, sf):
    return _names(spark, sf).select("p_partkey", F.explode(S.name_candidates("name")).alias("key"))


@query(
    "venue_grade", "B8",
    """SELECT s_suppkey, coalesce(grade, 'neocloud') AS grade FROM (
  SELECT s_suppkey, (list_value('aws', 'runpod', 'fal', 'oracle', 'elsewhere'))[1 + s_nationkey % 5] AS provider FROM supplier) x
LEFT JOIN (VALUES ('aws', 'hyperscaler'), ('oracle', 'hyperscaler'), ('runpod', 'marketplace'), ('fal', 'marketplace')) AS g(provider, grade)
USING (provider)""",
)
def venue_grade(spark, sf):
    names = F.array(*[F.lit(n) for n in ("aws", "runpod", "fal", "oracle", "elsewhere")])
    provider = F.element_at(names, F.col("s_nationkey") % 5 + 1)
    return table(spark, sf, "supplier").select("s_suppkey", S.venue_grade(provider).alias("grade"))


@query(
    "price_tier", "B9",
    """SELECT o_orderkey, CASE WHEN p IS NULL THEN 'unmatched' WHEN p = 0 THEN 'free' WHEN p < 1 THEN 'under_1'
       WHEN p <= 5 THEN '1_to_5' ELSE 'over_5' END AS tier FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 50000) END AS p FROM orders)""",
)
def price_tier(spark, sf):
    price = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 50000))
    return table(spark, sf, "orders").select("o_orderkey", S.price_tier(price).alias("tier"))


@query(
    "is_free", "B10",
    "SELECT p_partkey, suffix(p_name || CASE WHEN p_size < 5 THEN ':free' ELSE '' END, ':free') AS free FROM part",
)
def is_free(spark, sf):
    name = F.concat(F.col("p_name"), F.when(F.col("p_size") < 5, ":free").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", S.is_free(name).alias("free"))


GUIDE_SQL = """guide AS (
  SELECT entity, fy, q, value, CASE q WHEN 1 THEN 'fy' || fy || ' capex guidance low' WHEN 2 THEN 'fy' || fy || ' capex guidance previous high'
    WHEN 3 THEN 'calendar ' || fy || ' capex guidance' ELSE 'capex actual' END AS metric,
    'FY' || fy || CASE WHEN q = 4 THEN '' ELSE ' Q' || q END AS period FROM quarterly)"""


def _guide(spark, sf):
    fy = F.col("fy").cast("string")
    metric = (
        F.when(F.col("q") == 1, F.concat(F.lit("fy"), fy, F.lit(" capex guidance low")))
        .when(F.col("q") == 2, F.concat(F.lit("fy"), fy, F.lit(" capex guidance previous high")))
        .when(F.col("q") == 3, F.concat(F.lit("calendar "), fy, F.lit(" capex guidance")))
        .otherwise("capex actual")
    )
    period = F.concat(F.lit("FY"), fy, F.when(F.col("q") == 4, "").otherwise(F.concat(F.lit(" Q"), F.col("q").cast("string"))))
    return quarterly(spark, sf).select("entity", "fy", "q", "value", metric.alias("metric"), period.alias("period"))


@query(
    "guidance_metric", "B11",
    with_(ORDER_MODELS, QUARTERLY, GUIDE_SQL, """SELECT entity, fy, q, CASE WHEN q IN (1, 2) THEN 'FY' || fy WHEN q = 3 THEN 'CY' || fy END AS bucket,
       CASE q WHEN 1 THEN 'low' WHEN 2 THEN 'prev_high' WHEN 3 THEN 'calendar' END AS field FROM guide"""),
)
def guidance_metric(spark, sf):
    g = S.guidance_metric("metric")
    return _guide(spark, sf).select("entity", "fy", "q", g["bucket"].alias("bucket"), g["field"].alias("field"))


@query(
    "fiscal_quarter", "B12",
    with_(ORDER_MODELS, QUARTERLY, GUIDE_SQL, """SELECT entity, fy, q, CASE WHEN q < 4 THEN fy END AS label_year, CASE WHEN q < 4 THEN q END AS label_quarter FROM guide"""),
)
def fiscal_quarter(spark, sf):
    label = S.fiscal_quarter("period")
    return _guide(spark, sf).select("entity", "fy", "q", label["fy"].alias("label_year"), label["q"].alias("label_quarter"))


@query(
    "calendar_group", "B13",
    with_(ORDER_MODELS, QUARTERLY, """SELECT entity, fy, q, right(CAST(fy - CASE WHEN q IN (1, 2) THEN 1 ELSE 0 END AS VARCHAR), 2) || CASE q WHEN 1 THEN 'Q3' WHEN 2 THEN 'Q4'
       WHEN 3 THEN 'Q1' ELSE 'Q2' END AS shifted, right(CAST(fy AS VARCHAR), 2) || 'Q' || q AS plain FROM quarterly"""),
)
def calendar_group(spark, sf):
    return quarterly(spark, sf).select(
        "entity", "fy", "q",
        S.calendar_group(F.lit("Microsoft"), "fy", "q").alias("shifted"),
        S.calendar_group(F.lit("Meta"), "fy", "q").alias("plain"),
    )


@query(
    "complete_period", "B14",
    """SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE + 6 < DATE '2001-07-01' AS complete,
       date_trunc('week', o_orderdate)::DATE + 6 <= DATE '2001-07-01' AS complete_inclusive FROM orders""",
)
def complete_period(spark, sf):
    week = F.date_trunc("week", "o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        S.complete_period(week, day("2001-07-01")).alias("complete"),
        S.complete_period(week, day("2001-07-01"), inclusive=True).alias("complete_inclusive"),
    )


@query(
    "series_identity", "B15",
    """SELECT p_partkey, sha256(p_type || '|' || p_brand || '|' || p_name) AS series_id,
       'sha256:' || sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS content FROM part""",
)
def series_identity(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.series_id("p_type", "p_brand", "p_name").alias("series_id"), S.content_hash("p_brand", "p_size").alias("content")
    )


@query(
    "label_case", "B16",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Oracle' WHEN 'BUILDING' THEN 'Amazon' ELSE replace(c_mktsegment, '_', ' ') END AS label,
       replace(lower(c_mktsegment) || '_capex', '_', ' ') AS signal FROM customer""",
)
def label_case(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        S.label_case("c_mktsegment", {"MACHINERY": "Oracle", "BUILDING": "Amazon"}).alias("label"),
        S.label_case(F.concat(F.lower("c_mktsegment"), F.lit("_capex")), config.SIGNAL_LABELS).alias("signal"),
    )


@query(
    "name_trimming", "B17",
    """SELECT p_partkey, p_type AS entity, p_brand AS sku FROM part""",
)
def name_trimming(spark, sf):
    sku = F.concat(F.lit("Standard_"), F.col("p_brand"), F.lit("_v5"))
    return table(spark, sf, "part").select(
        "p_partkey", S.strip_prefix(F.concat(F.lit("NVIDIA "), F.col("p_type"))).alias("entity"), S.sku_short(sku).alias("sku")
    )


@query(
    "price_range_text", "B18",
    with_(OFFERS, """SELECT date, series, '$' || printf('%.2f', min(value)) || ' to $' || printf('%.2f', max(value)) AS price_range FROM offers GROUP BY ALL"""),
)
def price_range_text(spark, sf):
    edges = offers(spark, sf).groupBy("date", "series").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return edges.select("date", "series", S.price_range_text("lo", "hi").alias("price_range"))


@query(
    "effective_date", "B19",
    """SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END, DATE '2024-01-01') AS effective FROM events""",
)
def effective_date(spark, sf):
    fetched = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, sf, "events").select("event_id", S.effective_date(fetched, day("2024-01-01")).alias("effective"))


@query(
    "date_range_filter", "B20",
    with_(OFFERS, "SELECT date, series, seq, value FROM offers WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"),
)
def date_range_filter(spark, sf):
    rows = S.date_range_filter(offers(spark, sf), "date", day("1998-01-01"), day("1998-03-31"))
    return rows.select("date", "series", "seq", "value")


@query("usd_billions", "B21", "SELECT c_custkey, abs(c_acctbal) / 1e9 AS usd_b FROM customer")
def usd_billions(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.usd_billions("c_acctbal").alias("usd_b"))


@query(
    "focus_filter", "B22",
    """SELECT event_id, event_type, value FROM events WHERE lower(event_type) IN ('view', 'error') AND value IS NOT NULL
AND abs(value) >= 5 AND (props LIKE '%9}' OR props LIKE '%1%')""",
)
def focus_filter(spark, sf):
    rows = S.focus_filter(table(spark, sf, "events"), "event_type", ["View", "Error"], "value", 5.0, ("props", ["%9}", "%1%"]))
    return rows.select("event_id", "event_type", "value")


@query(
    "indicators_to_long", "B23",
    with_(OFFERS, DAILY, """SELECT CAST(date AS VARCHAR) AS date, series, dataset, value FROM (
  SELECT date, series, 'level' AS dataset, value FROM daily UNION ALL
  SELECT date, series, 'breadth', CAST(entity_count AS DOUBLE) FROM daily UNION ALL
  SELECT date, series, 'spread', high - low FROM daily WHERE high > low) WHERE series IN ('A', 'R')"""),
)
def indicators_to_long(spark, sf):
    wide = daily_prices(spark, sf).select(
        F.col("date").cast("string"), "series", "value", "entity_count",
        F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).alias("spread"),
    )
    return S.indicators_to_long(wide, "date", "series", ["A", "R"], {"value": "level", "entity_count": "breadth", "spread": "spread"})


@query(
    "band_to_long", "B24",
    with_(OFFERS, DAILY, """SELECT series, date, 'lower' AS bound, low AS value FROM daily UNION ALL
SELECT series, date, 'upper', high FROM daily"""),
)
def band_to_long(spark, sf):
    return S.band_to_long(daily_prices(spark, sf), "date", {"low": "lower", "high": "upper"}, ["series"], "bound")


@query(
    "activity_days", "B4",
    with_(ACTIVITY, "SELECT user_id, seq, date FROM activity"),
)
def activity_days(spark, sf):
    return activity(spark, sf).select("user_id", "seq", "date")
