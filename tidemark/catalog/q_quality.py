"""Quality-gate and freshness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.catalog.adapters import ACTIVITY, DEPTH, OFFERS, USAGE, activity, day, depth, offers, table, usage
from tidemark.catalog.registry import query, with_
from tidemark.operators import quality as Q


def _graded(spark, sf):
    """Depth as daily series, usage as weekly series, activity as an event series."""
    daily = depth(spark, sf).select(F.col("source").alias("series"), "date", F.lit("daily").alias("freq"), (F.col("source") == "5-LOW").alias("proxy"))
    weekly = usage(spark, sf).select(F.col("model").alias("series"), "date", F.lit("weekly").alias("freq"), (F.col("model") == "Others").alias("proxy"))
    events = activity(spark, sf).select(F.col("event_type").alias("series"), "date", F.lit("event").alias("freq"), F.lit(False).alias("proxy"))
    return daily.unionByName(weekly).unionByName(events)


GRADED = """graded AS (
  SELECT source AS series, date, 'daily' AS freq, source = '5-LOW' AS proxy FROM depth UNION ALL
  SELECT model, date, 'weekly', model = 'Others' FROM usage UNION ALL SELECT event_type, date, 'event', false FROM activity),
spans AS (SELECT series, count(DISTINCT date) AS n, min(date) AS first_date, max(date) AS last_date, max(date) - min(date) AS span,
  any_value(freq) AS freq, bool_or(proxy) AS proxy FROM graded GROUP BY series),
quality AS (SELECT *, CASE freq WHEN 'daily' THEN n / (span + 1) * 100 WHEN 'weekly' THEN n / (span // 7 + 1) * 100 END AS cov FROM spans),
gates AS (SELECT *, coalesce(((freq = 'daily' AND n >= 10) OR (freq = 'weekly' AND n >= 8)) AND cov >= 80, false) AS chart FROM quality),
steps AS (SELECT *, chart AND ((freq = 'daily' AND n >= 20 AND span >= 24) OR (freq = 'weekly' AND n >= 12 AND span >= 77)) AS infl,
  chart AND freq = 'daily' AND n >= 60 AND span >= 74 AS e90 FROM gates)"""


@query(
    "series_quality", "H1",
    with_(DEPTH, USAGE, ACTIVITY, GRADED, """SELECT series, n AS valid_dates, first_date, last_date, span AS span_days, cov AS coverage_pct, chart AS eligible_for_chart,
  infl AND NOT proxy AS eligible_for_inflection, e90 AND NOT proxy AS eligible_for_90d,
  CASE WHEN freq = 'event' THEN 'event_series_only' WHEN freq = 'daily' AND n < 10 THEN 'insufficient_daily_history'
       WHEN freq = 'weekly' AND n < 8 THEN 'insufficient_weekly_history' WHEN NOT chart THEN 'insufficient_coverage'
       WHEN proxy THEN 'proxy_not_inflection_eligible' WHEN NOT infl THEN 'insufficient_30d_history'
       WHEN freq = 'daily' AND NOT e90 THEN 'insufficient_90d_history' END AS reason_code FROM steps"""),
)
def series_quality(spark, sf):
    return Q.series_quality(_graded(spark, sf), ["series"], "date", "freq", "proxy")


def _candidates(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_type").alias("panel"),
        F.when(F.col("p_size") > 3, F.col("p_type")).alias("billing"),
        F.when(F.col("p_brand") == "Brand#7", "unknown").otherwise(F.col("p_brand")).alias("variant"),
        F.substring_index("p_name", " ", 1).alias("region"),
        (F.col("p_size") - 4).alias("gpus"),
        F.substring_index("p_name", " ", -1).alias("source"),
    )
    return Q.panel_candidates(rows, "billing", "variant", "region", "gpus")


CANDIDATES = """candidates AS (
  SELECT p_partkey, p_type AS panel, p_brand, split_part(p_name, ' ', -1) AS source,
    CASE WHEN p_size <= 3 THEN 'missing_exact_configuration' WHEN p_brand = 'Brand#7' OR p_size = 4 THEN 'unstable_configuration' END AS panel_reason_code FROM part)"""


@query("panel_candidates", "H2", with_(CANDIDATES, "SELECT p_partkey, panel_reason_code, panel_reason_code IS NULL AS eligible FROM candidates"))
def panel_candidates(spark, sf):
    return _candidates(spark, sf).select("p_partkey", "panel_reason_code", "eligible")


@query(
    "panel_inference", "H2",
    with_(CANDIDATES, """SELECT panel, count(DISTINCT p_brand) AS members, count(DISTINCT source) AS sources,
  count(DISTINCT p_brand) >= 3 AND count(DISTINCT source) >= 2 AS eligible_for_market_inference FROM candidates WHERE panel_reason_code IS NULL GROUP BY panel"""),
)
def panel_inference(spark, sf):
    return Q.panel_inference(_candidates(spark, sf), "panel", "variant", "source")


def _freshness(spark, sf):
    policy = spark.createDataFrame(
        [("view", 36), ("click", 72), ("signup", 48), ("error", 1), ("refund", 216)], "event_type string, limit_hours int"
    )
    facts = activity(spark, sf)
    return Q.source_freshness(policy, facts, "event_type", "ts", "limit_hours", F.lit("2024-01-31 01:00:00").cast("timestamp"))


FRESH = """policy(event_type, limit_hours) AS (VALUES ('view', 36), ('click', 72), ('signup', 48), ('error', 1), ('refund', 216)),
seen AS (SELECT event_type, max(ts) AS latest_at, count(*) AS observation_rows FROM activity GROUP BY event_type),
freshness AS (SELECT p.event_type, limit_hours, observation_rows,
  (epoch(TIMESTAMP '2024-01-31 01:00:00') - floor(epoch(latest_at))) / 3600.0 AS age_hours FROM policy p LEFT JOIN seen USING (event_type)),
graded AS (SELECT *, CASE WHEN age_hours IS NULL THEN 'missing' WHEN age_hours > limit_hours THEN 'stale' ELSE 'fresh' END AS status FROM freshness)"""


@query("source_freshness", "H3", with_(ACTIVITY, FRESH, "SELECT event_type, limit_hours, observation_rows, status, round(age_hours, 6) AS age_hours FROM graded"))
def source_freshness(spark, sf):
    out = _freshness(spark, sf).withColumn("age_hours", F.round("age_hours", 6))
    return out.select("event_type", "limit_hours", "observation_rows", "status", "age_hours")


@query(
    "source_coverage", "H13",
    with_(ACTIVITY, FRESH, """SELECT count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'stale') AS stale,
  count(*) FILTER (WHERE status = 'missing') AS missing FROM graded WHERE event_type IN ('view', 'error', 'refund')"""),
)
def source_coverage(spark, sf):
    return Q.source_coverage(_freshness(spark, sf), "event_type", ["view", "error", "refund"])


@query(
    "cache_coverage", "H4",
    """WITH latest AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS latest_date FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS k, latest_date, DATE '2001-08-01' - latest_date AS age_days,
  coalesce(DATE '2001-08-01' - latest_date BETWEEN 0 AND 150, false) AS current FROM customer LEFT JOIN latest ON c_custkey = k""",
)
def cache_coverage(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    )
    universe = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return Q.cache_coverage(rows, universe, "k", "date", day("2001-08-01"))


@query(
    "grace_status", "H5",
    with_(DEPTH, """SELECT max(date) AS last_data_date, DATE '2001-08-06' - max(date) AS stale_days,
  CASE WHEN DATE '2001-08-06' - max(date) <= 7 THEN 'stale_last_good' ELSE 'failed' END AS status, DATE '2001-08-06' - max(date) <= 7 AS publishable FROM depth"""),
)
def grace_status(spark, sf):
    return Q.grace_status(depth(spark, sf), "date", day("2001-08-06"))


@query(
    "run_status", "H6",
    """SELECT CAST(o_orderdate AS DATE) AS run_date, count(*) AS sources, count(*) FILTER (WHERE o_orderstatus <> 'P') AS ok_sources,
  CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'fresh' WHEN bool_or(o_orderstatus <> 'P') THEN 'partial' ELSE 'failed' END AS status FROM orders GROUP BY 1""",
)
def run_status(spark, sf):
    runs = table(spark, sf, "orders").withColumn("run_date", F.col("o_orderdate").cast("date"))
    return Q.run_status(runs, ["run_date"], F.col("o_orderstatus") != "P")


@query(
    "overall_status", "H6",
    """SELECT CASE WHEN ok THEN 'ready' ELSE 'degraded' END AS status, ok AS publishable FROM (
  SELECT bool_and(o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') OR o_orderstatus <> 'P') AS ok FROM orders)""",
)
def overall_status(spark, sf):
    rows = table(spark, sf, "orders").withColumn("publishable", F.col("o_orderstatus") != "P")
    return Q.overall_status(rows, "o_orderpriority", "publishable", ["4-NOT SPECIFIED", "5-LOW"])


def _sources(spark, sf, names):
    """One status per named source, read off the customers dealt to it: every status occurs, some unpublishable."""
    place = F.pmod("c_custkey", F.lit(len(names))).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), place + 1)
    rows = table(spark, sf, "customer").groupBy(name.alias("source")).agg(F.sum("c_nationkey").alias("n"))
    status = F.element_at(F.array(*[F.lit(x) for x in STATUSES]), (F.pmod("n", F.lit(len(STATUSES))) + 1).cast("int"))
    return rows.select("source", status.alias("status"), (F.pmod("n", F.lit(5)) != 0).alias("publishable"))


STATUSES = ["fresh", "stale_last_good", "current_for_frequency", "odd"]
#: A landed set in which an unlisted source stands for the last expected one.
WRONG_SET = [*config.EXPECTED_SOURCES[:-1], "unlisted_source"]


def _listed(values):
    return ", ".join(f"'{v}'" for v in values)


def _sources_sql(names):
    return f"""sources AS (SELECT source, list_extract([{_listed(STATUSES)}], CAST(n % {len(STATUSES)} AS INTEGER) + 1) AS status, n % 5 <> 0 AS publishable FROM (
  SELECT list_extract([{_listed(names)}], CAST(c_custkey % {len(names)} AS INTEGER) + 1) AS source, CAST(sum(c_nationkey) AS BIGINT) AS n FROM customer GROUP BY 1))"""


@query(
    "publish_violations", "H7",
    with_(_sources_sql(config.EXPECTED_SOURCES), f"""by_class AS (SELECT source, CASE
  WHEN source IN ({_listed(config.INFORMATIONAL_SOURCES)}) THEN CASE WHEN status NOT IN ({_listed(config.INFORMATIONAL_STATUSES)}) THEN 'unknown_status' END
  WHEN source = 'sec_capex' THEN CASE WHEN NOT (status IN ({_listed(config.CAPEX_READY_STATUSES)}) AND publishable) THEN 'capex_not_ready' END
  WHEN NOT ((status = 'fresh' OR (status = 'stale_last_good' AND source IN ({_listed(config.STALE_TOLERANT_SOURCES)}))) AND publishable) THEN 'not_fresh' END AS violation FROM sources)""",
          """SELECT * FROM by_class WHERE violation IS NOT NULL UNION ALL
SELECT source, 'capex_cache_incomplete' FROM sources WHERE source = 'sec_capex' AND status = 'current_for_frequency' AND EXISTS (SELECT 1 FROM region WHERE r_regionkey % 2 = 1)"""),
)
def publish_violations(spark, sf):
    expected = spark.createDataFrame([(n,) for n in config.EXPECTED_SOURCES], "source string")
    coverage = table(spark, sf, "region").select(F.col("r_name").alias("entity"), (F.col("r_regionkey") % 2 == 0).alias("current"))
    return Q.publish_violations(_sources(spark, sf, config.EXPECTED_SOURCES), expected, coverage)


@query(
    "publish_set_violations", "H7",
    with_(_sources_sql(WRONG_SET), f"expected AS (SELECT unnest([{_listed(config.EXPECTED_SOURCES)}]) AS source)",
          """SELECT source, 'missing_source' AS violation FROM expected WHERE source NOT IN (SELECT source FROM sources)
UNION ALL SELECT source, 'unexpected_source' FROM sources WHERE source NOT IN (SELECT source FROM expected)"""),
)
def publish_set_violations(spark, sf):
    expected = spark.createDataFrame([(n,) for n in config.EXPECTED_SOURCES], "source string")
    coverage = table(spark, sf, "region").select(F.col("r_name").alias("entity"), F.lit(True).alias("current"))
    return Q.publish_violations(_sources(spark, sf, WRONG_SET), expected, coverage)


@query(
    "stamp_violations", "H7",
    """WITH s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, o_orderpriority <> '1-URGENT' AND o_totalprice < 250000 AS ready FROM orders),
v AS (SELECT CASE WHEN day IS NULL THEN 'invalid_generated_at' WHEN day <> DATE '2000-06-01' THEN 'wrong_generated_date' END AS violation FROM s
  UNION ALL SELECT CASE WHEN NOT ready THEN 'not_ready' END FROM s)
SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY violation""",
)
def stamp_violations(spark, sf):
    stamps = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "no time").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("generated_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "degraded").otherwise("ready").alias("status"),
        (F.col("o_totalprice") < 250000).alias("publishable"),
    )
    return Q.stamp_violations(stamps, day("2000-06-01")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "local_only_violations", "H7, F9",
    with_(USAGE, "weeks AS (SELECT DISTINCT date, CASE WHEN month(date) % 2 = 0 THEN 'h' ELSE '' END AS sha FROM usage), shares AS (SELECT DISTINCT date FROM usage WHERE tokens % 3 = 0)",
          """SELECT date, 'missing_share_history' AS violation FROM weeks WHERE date NOT IN (SELECT date FROM shares)
UNION ALL SELECT date, 'missing_source_hash' FROM weeks WHERE sha = ''"""),
)
def local_only_violations(spark, sf):
    rows = usage(spark, sf)
    weeks = rows.select("date", F.when(F.month("date") % 2 == 0, "h").otherwise("").alias("sha")).distinct()
    return Q.local_only_violations(weeks, rows.where("tokens % 3 = 0"), "date", F.col("sha"))


@query(
    "required_fields", "H8",
    """SELECT p_partkey, unnest(list_filter(list_value(CASE WHEN p_size <= 3 THEN 'missing:billing' END, CASE WHEN p_size > 40 THEN 'bad_date:day' END,
  'non_numeric:p_brand', CASE WHEN p_size < 10 THEN 'blank:name' END), lambda x: x IS NOT NULL)) AS violation FROM part""",
)
def required_fields(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        "p_brand",
        F.when(F.col("p_size") > 3, F.col("p_type")).alias("billing"),
        F.when(F.col("p_size") > 40, "2024-13-40").otherwise("2024-01-05").alias("day"),
        F.when(F.col("p_size") < 10, "  ").otherwise(F.col("p_name")).alias("name"),
    )
    return Q.required_fields(rows, "p_partkey", ["billing"], ["day"], ["p_brand"], ["name"])


@query(
    "min_periods", "H9",
    with_(USAGE, "n AS (SELECT count(DISTINCT date) AS periods FROM usage)",
          "SELECT periods, required, 'too_few_periods' AS violation FROM n, (VALUES (10), (52), (5200)) AS r(required) WHERE periods < required"),
)
def min_periods(spark, sf):
    rows = usage(spark, sf)
    checks = [Q.min_periods(rows, "date", n) for n in (10, 52, 5200)]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query(
    "provenance_check", "H10",
    """SELECT o_orderkey, unnest(list_filter(list_value(CASE o_orderstatus WHEN 'P' THEN 'source_type_rejected' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown_collection_method' END, CASE WHEN o_totalprice > 300000 THEN 'confidence_out_of_range' END),
  lambda x: x IS NOT NULL)) AS violation FROM orders""",
)
def provenance_check(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "seed").otherwise("official").alias("source_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "guess").otherwise("html_parse").alias("collection_method"),
        (F.col("o_totalprice") / 300000).alias("confidence"),
    )
    return Q.provenance_check(rows, "o_orderkey")


@query(
    "quality_events", "H11, B15",
    """SELECT 'run1:' || o_orderkey || ':MISSING:' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 12) AS event_id, 'error' AS severity,
  o_orderpriority || ':' || o_orderkey AS affected_key, 'MISSING' AS error_code, true AS is_blocking, CAST(0 AS DOUBLE) AS confidence, '2024-01-01T00:00:00Z' AS fetched_at
FROM orders WHERE o_orderstatus = 'P'""",
)
def quality_events(spark, sf):
    failed = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("string").alias("k"),
        "o_orderpriority",
        F.lit("MISSING").alias("code"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("o_custkey").cast("string"), 256)).alias("payload"),
    )
    affected = F.concat_ws(":", "o_orderpriority", "k")
    return Q.quality_events(failed, "k", "code", F.lit("run1"), "payload", affected, F.lit("2024-01-01T00:00:00Z"))


@query(
    "size_floor", "H12",
    """SELECT 'nation' AS side, count(*) AS rows, 'unexpectedly_small' AS violation FROM nation HAVING count(*) < 100
UNION ALL SELECT 'region', count(*), 'unexpectedly_small' FROM region HAVING count(*) < 100""",
)
def size_floor(spark, sf):
    return Q.size_floor({n: table(spark, sf, n) for n in ("nation", "region", "part", "orders")})


@query(
    "pipeline_health", "H14",
    with_(ACTIVITY, "SELECT event_type, seq, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, seq DESC) AS rn FROM activity) WHERE rn = 1"),
)
def pipeline_health(spark, sf):
    return Q.pipeline_health(activity(spark, sf), "event_type", "ts", "seq").select("event_type", "seq", "user_id", "value")


@query(
    "ready_counts", "H15",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'P') AS healthy,
  count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS degraded,
  count(*) FILTER (WHERE o_orderstatus <> 'P') - count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS ready,
  max(o_custkey) AS oldest_cache_days FROM orders""",
)
def ready_counts(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "fresh").when(F.col("o_orderstatus") == "F", "current_for_frequency").otherwise("failed")
    warnings = F.when(F.col("o_orderpriority") == "1-URGENT", '["a", "b"]').when(F.col("o_orderpriority") == "2-HIGH", "3").when(
        F.col("o_orderpriority") == "5-LOW", "[]"
    )
    rows = table(spark, sf, "orders").withColumn("status", status).withColumn("warnings", warnings)
    return Q.ready_counts(rows, "status", "warnings", "o_custkey")


@query(
    "offer_counts_by_panel", "H2, D21",
    with_(OFFERS, "SELECT series, count(DISTINCT provider) AS members FROM offers GROUP BY series"),
)
def offer_counts_by_panel(spark, sf):
    return offers(spark, sf).groupBy("series").agg(F.count_distinct("provider").alias("members"))
