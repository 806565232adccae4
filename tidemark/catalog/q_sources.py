"""Source-parser queries: table rows are written as landed JSON documents and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.adapters import (
    DEPTH, OFFERS, ORDER_MODELS, USAGE, USAGE_LEDGER, cents, depth, offers, table, usage, usage_ledger,
)
from tidemark.catalog.registry import query, with_
from tidemark.sources import readers as S


def _landed(df, document, schema, *keep):
    """Rows as JSON text parsed under the declared schema, as a reader would see them."""
    text = df.select(*keep, F.to_json(document).alias("_json"))
    return text.select(*keep, F.from_json("_json", schema).alias("_d")).select(*keep, "_d.*")


# Each line becomes a document of two offers, the second of which never qualifies.
LINES = """lines AS (SELECT CAST(l_shipdate AS DATE)::VARCHAR AS date, floor(l_extendedprice * 100 + 0.5) AS price, l_linenumber, l_suppkey, l_quantity::INTEGER AS qty,
  l_returnflag, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'H100' WHEN 'R' THEN 'RTX 5090' ELSE 'L40S' END AS fam FROM lineitem)"""


def _lines(spark, sf):
    code = F.when(F.col("l_returnflag") == "A", "h100-sxm").when(F.col("l_returnflag") == "R", "RTX_5090").otherwise("L40S pcie")
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("date"), cents("l_extendedprice").alias("price"),
        "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"), "l_returnflag", "l_linestatus", code.alias("code"),
    )


@query(
    "offers_marketplace_a", "A2, B1, B2",
    with_(LINES, """SELECT date, fam AS series, price, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber END AS gpus,
  CASE WHEN l_linenumber = 2 THEN 'unknown' ELSE l_suppkey::VARCHAR END AS provider, qty AS server_total FROM lines WHERE l_linestatus = 'O' AND l_returnflag <> 'N'"""),
)
def offers_marketplace_a(spark, sf):
    currency = F.when(F.col("l_returnflag") == "A", F.lit(None)).when(F.col("l_returnflag") == "R", "usd").otherwise("EUR")

    def offer(price):
        return F.struct(
            (F.col("l_linestatus") == "O").alias("isAvailable"), currency.alias("currency"),
            F.struct(F.col("code").alias("slug"), F.lit("card").alias("name")).alias("gpu"), price.cast("string").alias("pricePerGpu"),
            F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("gpuCount"),
            F.when(F.col("l_linenumber") != 2, F.col("l_suppkey").cast("string")).alias("provider"),
        )

    document = F.struct(
        "date", F.struct(F.col("qty").alias("total")).alias("pagination"), F.array(offer(F.col("price")), offer(F.lit("n/a"))).alias("data")
    )
    return S.offers_marketplace_a(_landed(_lines(spark, sf), document, schemas.MARKETPLACE_A))


@query(
    "offers_marketplace_b", "A3",
    with_(LINES, "SELECT date, fam AS series, price / l_linenumber AS price, l_linenumber::BIGINT AS gpus FROM lines WHERE l_linestatus = 'O' AND fam <> 'L40S'"),
)
def offers_marketplace_b(spark, sf):
    def offer(rented):
        return F.struct(
            F.col("code").alias("gpu_name"), F.lit(True).alias("rentable"), rented.alias("rented"), F.lit("Verified").alias("verification"),
            F.col("l_linenumber").cast("string").alias("num_gpus"), F.col("price").cast("string").alias("dph_total"),
        )

    document = F.struct("date", F.array(offer(F.col("l_linestatus") != "O"), offer(F.lit(True))).alias("offers"))
    return S.offers_marketplace_b(_landed(_lines(spark, sf), document, schemas.MARKETPLACE_B), ["H100", "RTX 5090"])


@query(
    "offers_tiered", "A4",
    with_(LINES, """SELECT date, fam AS series, CASE WHEN l_linestatus = 'O' THEN least(price, qty * 1000.0) ELSE price END AS price, qty::BIGINT AS gpus FROM lines WHERE l_linenumber <> 3"""),
)
def offers_tiered(spark, sf):
    mig = F.when(F.col("l_linenumber") == 3, " MIG slice").otherwise("")
    card = F.struct(
        F.col("code").alias("id"), F.concat(F.lit("card"), mig).alias("displayName"), F.lit(True).alias("secureCloud"),
        (F.col("l_linestatus") == "O").alias("communityCloud"), F.col("price").cast("string").alias("securePrice"),
        (F.col("qty") * 1000).cast("string").alias("communityPrice"), F.col("qty").cast("double").alias("maxGpuCount"),
    )
    dead = F.struct(
        F.col("code").alias("id"), F.lit("dead").alias("displayName"), F.lit(False).alias("secureCloud"), F.lit(True).alias("communityCloud"),
        F.lit("3").alias("securePrice"), F.lit("0").alias("communityPrice"), F.lit(1.0).alias("maxGpuCount"),
    )
    document = F.struct("date", F.struct(F.array(card, dead).alias("gpuTypes")).alias("data"))
    return S.offers_tiered(_landed(_lines(spark, sf), document, schemas.TIERED), ["H100", "RTX 5090", "L40S"])


@query(
    "provider_offers", "A5, B8",
    """SELECT DISTINCT CAST(l_shipdate AS DATE)::VARCHAR AS date, 'aws' AS provider, 'hyperscaler' AS venue_grade, CASE l_returnflag WHEN 'A' THEN 'H100' WHEN 'R' THEN 'RTX 5090' ELSE 'L40S' END AS series,
  l_linestatus = 'O' AS is_spot, floor(l_extendedprice * 100 + 0.5) AS usd_per_gpu_hour FROM lineitem""",
)
def provider_offers(spark, sf):
    def offer(price):
        return F.struct(
            F.lit("  AWS ").alias("provider"), F.col("code").alias("gpu"), F.lit(80.0).alias("vram_gb"), price.cast("string").alias("usd_hr"),
            F.when(F.col("l_linestatus") == "O", "Spot").otherwise("On-Demand").alias("kind"), F.lit("u").alias("source_url"),
        )

    document = F.struct("date", F.array(offer(F.col("price")), offer(F.col("price")), offer(F.lit("free")), offer(F.lit(0))).alias("offers"))
    out = S.provider_offers(_landed(_lines(spark, sf), document, schemas.PROVIDER_OFFERS))
    return out.select("date", "provider", "venue_grade", "series", (F.col("kind") == "spot").alias("is_spot"), "usd_per_gpu_hour")


@query("index_history", "A6, F6", with_(DEPTH, "SELECT date::VARCHAR AS date, source AS series, offers::DOUBLE AS index_value FROM depth"))
def index_history(spark, sf):
    def point(hour, value):
        return F.struct(F.concat(F.col("date").cast("string"), F.lit(hour)).alias("timestamp"), value.cast("double").alias("index_value"))

    document = F.struct(
        F.col("source").alias("gpu"), F.lit(True).alias("success"),
        F.array(point("T00", F.lit(-1)), point("T06", F.col("offers")), point("T12", F.col("offers") + 1)).alias("data"),
    )
    return S.index_history(_landed(depth(spark, sf), document, schemas.INDEX_HISTORY)).select("date", "series", "index_value")


@query("realized_price", "A7", with_(DEPTH, "SELECT date::VARCHAR AS date, source AS series, offers::DOUBLE AS index_value FROM depth WHERE source <> '5-LOW'"))
def realized_price(spark, sf):
    lab = F.when(F.col("source") == "5-LOW", "").otherwise(F.col("source"))
    point = F.struct(F.col("date").cast("string").alias("date"), lab.alias("lab"), F.col("offers").cast("double").alias("indexPerMtok"))
    short = F.struct(F.lit("2024-1-1").alias("date"), lab.alias("lab"), F.lit(1.0).alias("indexPerMtok"))
    document = F.struct(F.lit(True).alias("success"), F.array(point, short).alias("data"))
    return S.realized_price(_landed(depth(spark, sf), document, schemas.REALIZED_PRICE)).select("date", "series", "index_value")


@query(
    "wide_index_to_long", "A8",
    with_(DEPTH, """SELECT date, 'H100' AS series, offers::DOUBLE AS index_value FROM depth UNION ALL SELECT date, 'B200', offers::DOUBLE - 1 FROM depth WHERE offers > 1"""),
)
def wide_index_to_long(spark, sf):
    day = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss")
    point = F.struct(day.alias("date"), F.col("offers").cast("double").alias("h100"), F.lit(None).cast("double").alias("a100"), (F.col("offers") - 1).cast("double").alias("b200"))
    bad = F.struct(F.lit("soon").alias("date"), F.lit(1.0).alias("h100"), F.lit(1.0).alias("a100"), F.lit(1.0).alias("b200"))
    document = F.struct(F.lit("ok").alias("status"), F.array(point, bad).alias("index"))
    landed = _landed(depth(spark, sf), document, schemas.WIDE_INDEX)
    return S.wide_index_to_long(landed, {"h100": "H100", "a100": "A100", "b200": "B200"})


@query(
    "contract_bands", "A9",
    with_(DEPTH, """SELECT date::VARCHAR AS date, 'H100-1y' AS series, offers::DOUBLE AS low_value, offers::DOUBLE + 2 AS high_value, source AS label FROM depth"""),
)
def contract_bands(spark, sf):
    item = F.to_json(
        F.struct(
            F.col("source").alias("period"), F.date_format("date", "EEE, dd MMM yyyy").alias("period_start"),
            F.array(F.col("offers"), F.col("offers") + 2).alias("1y"), F.array(F.lit(0), F.lit(3)).alias("2y"), F.array(F.lit(1)).alias("3y"),
        )
    )
    document = F.struct(F.lit("ok").alias("status"), F.array(F.struct(F.array(item).alias("data"))).alias("contract"))
    return S.contract_bands(_landed(depth(spark, sf), document, schemas.WIDE_INDEX))


@query(
    "change_point_ledger", "A10",
    with_(OFFERS, """SELECT model || '#' || seq AS model, date::VARCHAR AS first_seen, date, 0 AS seq, value AS input, gpus::DOUBLE AS output FROM offers
UNION ALL SELECT model || '#' || seq, date::VARCHAR, date + 1, 1, value + 1, gpus::DOUBLE FROM offers"""),
)
def change_point_ledger(spark, sf):
    text = lambda c: c.cast("string")
    point = lambda d, v: F.array(text(d), text(v), text(F.col("gpus")))
    record = F.struct(
        F.array(point(F.col("date"), F.col("value")), point(F.date_add("date", 1), F.col("value") + 1), F.array(F.lit("x"), F.lit("1"))).alias("points")
    )
    document = F.struct(F.lit("2024-01-01").alias("as_of"), F.create_map(F.concat_ws("#", "model", "seq"), record).alias("models"))
    out = S.change_point_ledger(_landed(offers(spark, sf), document, schemas.LEDGER))
    return out.select("model", "first_seen", "date", "seq", "input", "output")


def _catalog(spark, sf):
    """A catalog as arrays of parts by brand and size, at most one entry per part."""
    entry = F.struct(
        F.concat_ws("/", "p_type", "p_brand").alias("id"), F.col("p_name").alias("canonical_slug"), F.lit("").alias("name"),
        F.struct(F.col("p_retailprice").cast("string").alias("prompt"), F.lit("-1").alias("completion")).alias("pricing"),
    )
    document = F.struct(F.array(entry).alias("data"))
    landed = _landed(table(spark, sf, "part"), document, schemas.CATALOG, "p_partkey")
    return S.current_catalog(landed), landed


@query(
    "current_catalog", "A11, B5",
    "SELECT p_type || '/' || p_brand AS id, p_name AS canonical_slug, p_type || '/' || p_brand AS name, p_retailprice * 1000000 AS input_usd_per_1m, CAST(NULL AS DOUBLE) AS output_usd_per_1m FROM part",
)
def current_catalog(spark, sf):
    return _catalog(spark, sf)[0].drop("seq")


@query(
    "alias_map", "A11",
    """WITH pairs AS (SELECT p_type || '/' || p_brand AS id, p_name AS slug, p_partkey AS seq FROM part),
both_names AS (SELECT id AS alias, id, seq, 0 AS k FROM pairs UNION ALL SELECT slug, id, seq, 1 FROM pairs)
SELECT alias, arg_max(id, seq * 2 + k) AS target FROM both_names GROUP BY alias""",
)
def alias_map(spark, sf):
    catalog = table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.concat_ws("/", "p_type", "p_brand").alias("id"), F.col("p_name").alias("canonical_slug")
    )
    return S.alias_map(catalog)


@query(
    "provider_map_prices", "A12",
    with_(LINES, """SELECT date, fam AS series, price AS average, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
  price + qty + l_linenumber - greatest(price, qty, l_linenumber) - least(price, qty, l_linenumber) AS value, 3 AS provider_count FROM lines"""),
)
def provider_map_prices(spark, sf):
    # One document per line; its map holds three positive prices and one zero.
    number = lambda c: c.cast("double")
    prices = F.create_map(
        F.lit("a"), number(F.col("price")), F.lit("b"), number(F.col("qty")), F.lit("c"), number(F.col("l_linenumber")), F.lit("d"), F.lit(0.0)
    )
    point = F.struct("date", number(F.col("price")).alias("avg_price"), prices.alias("provider_prices"))
    document = F.struct(F.create_map(F.col("code"), F.array(point)).alias("data"))
    landed = _landed(_lines(spark, sf), document, schemas.PROVIDER_MAP)
    return S.provider_map_prices(landed, {"h100-sxm": "H100", "RTX_5090": "RTX 5090", "L40S pcie": "L40S"})


CELLS = """cells AS (SELECT o_orderstatus AS gpu, CAST(o_orderdate AS DATE)::VARCHAR AS date, o_orderpriority AS provider,
  sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT))::DOUBLE AS total, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) FILTER (WHERE o_custkey > 50)::DOUBLE AS available FROM orders GROUP BY ALL)"""


def _cells(spark, sf):
    money = cents("o_totalprice").cast("double")
    cell = F.struct(
        F.col("o_orderdate").cast("date").cast("string").alias("date"), F.when(F.col("o_custkey") > 50, money).alias("available"), money.alias("total")
    )
    empty = F.struct(F.lit("2030-01-01").alias("date"), F.lit(1.0).alias("available"), F.lit(0.0).alias("total"))
    provider = F.struct(
        F.lit("").alias("providerName"), F.col("o_orderpriority").alias("providerSlug"), F.array(F.struct(F.array(cell, empty).alias("cells"))).alias("counts")
    )
    document = F.struct(F.col("o_orderstatus").alias("gpu"), F.array(provider).alias("providers"))
    return S.availability_cells(_landed(table(spark, sf, "orders"), document, schemas.AVAILABILITY))


@query("availability_cells", "A13", with_(CELLS, "SELECT gpu, date, provider, coalesce(available, 0) AS available, total FROM cells"))
def availability_cells(spark, sf):
    return _cells(spark, sf)


@query(
    "availability_days", "A13, D9",
    with_(CELLS, "SELECT gpu, date, 100 * coalesce(sum(available), 0) / sum(total) AS availability_pct, string_agg(provider, ',' ORDER BY provider) AS providers FROM cells GROUP BY gpu, date"),
)
def availability_days(spark, sf):
    out = S.availability_days(_cells(spark, sf))
    names = F.array_join(F.array_sort(F.map_keys("availability_by_provider")), ",")
    return out.select("gpu", "date", "availability_pct", names.alias("providers"))


@query(
    "price_gap", "A14",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND s_nationkey > 5 THEN ((s_acctbal + s_nationkey) / s_acctbal - 1) * 100 END AS gap FROM supplier",
)
def price_gap(spark, sf):
    available = F.when(F.col("s_nationkey") > 5, F.col("s_acctbal") + F.col("s_nationkey"))
    return table(spark, sf, "supplier").select("s_suppkey", S.price_gap(F.col("s_acctbal"), available).alias("gap"))


@query(
    "monthly_history", "A15, F2",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS gpu, o_orderpriority AS provider, arg_max(o_totalprice, o_orderkey) AS on_demand_price,
  arg_max(o_custkey, o_orderkey)::DOUBLE AS spot_price FROM orders GROUP BY ALL""",
)
def monthly_history(spark, sf):
    item = F.struct(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("provider"),
        F.col("o_totalprice").alias("onDemandPrice"), F.col("o_custkey").cast("double").alias("spotPrice"),
    )
    document = F.struct(F.col("o_orderstatus").alias("gpu"), F.array(item).alias("history"))
    return S.monthly_history(_landed(table(spark, sf, "orders"), document, schemas.MONTHLY, "o_orderkey"), F.col("o_orderkey"))


@query(
    "fixings_from_text", "A20",
    """SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey::VARCHAR AS series_id, 'chip ' || o_orderstatus AS chip, 'spot' AS tenor, o_custkey / 4 AS price,
  o_custkey AS obs_count, o_orderpriority AS venue_count, CASE WHEN o_orderstatus = 'F' THEN -(o_custkey / 8) END AS delta_30d_pct FROM orders""",
)
def fixings_from_text(spark, sf):
    number = lambda c: c.cast("string")
    delta = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(", delta30d: -"), number(F.col("o_custkey") / 8))).otherwise("")
    text = F.concat(
        F.lit("export const series = [{ id: '"), number(F.col("o_orderkey")), F.lit("', chipName: 'chip "), F.col("o_orderstatus"),
        F.lit("', tenor: 'spot',\n price: "), number(F.col("o_custkey") / 4), F.lit(", obs: "), number(F.col("o_custkey")),
        F.lit(", venueCount: '"), F.col("o_orderpriority"), F.lit("'"), delta, F.lit(" }];"),
    )
    docs = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), text.alias("text"))
    return S.fixings_from_text(docs)


@query(
    "weekly_usage_map", "A21, D12",
    with_(USAGE, "SELECT date, model, CASE WHEN model = 'Others' THEN model ELSE split_part(model, '/', 1) END AS provider, tokens::DOUBLE AS tokens FROM usage"),
)
def weekly_usage_map(spark, sf):
    point = F.struct(F.col("date").cast("string").alias("x"), F.create_map(F.col("model"), F.col("tokens").cast("double")).alias("ys"))
    document = F.struct(F.struct(F.array(point).alias("data")).alias("data"))
    return S.weekly_usage_map(_landed(usage(spark, sf), document, schemas.WEEKLY_USAGE))


@query(
    "official_events", "A23",
    """SELECT o_orderkey::VARCHAR AS event_id, 'capex' || b.suffix AS metric, o_custkey * b.factor AS value FROM orders
JOIN (VALUES ('', 1.0::DOUBLE, 'F'), ('_low', 1.0, 'O'), ('_high', 2.0, 'O'), ('_previous_high', 3.0, 'O')) AS b(suffix, factor, status) ON o_orderstatus = b.status""",
)
def official_events(spark, sf):
    k = F.col("o_custkey").cast("double")
    band = F.to_json(F.struct(k.alias("low"), (k * 2).alias("high"), (k * 3).alias("previous_high")))
    value = F.when(F.col("o_orderstatus") == "O", band).when(F.col("o_orderstatus") == "F", k.cast("string")).otherwise("pending")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.lit("capex").alias("metric"), value.alias("value"))
    return S.official_events(rows)


@query(
    "weekly_catalog_asof", "A25, C1",
    with_(ORDER_MODELS, USAGE_LEDGER, """snaps AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, model, max(price) AS cost FROM usage_ledger GROUP BY ALL),
snap_days AS (SELECT DISTINCT date AS snapshot_date FROM snaps),
weeks AS (SELECT CAST(unnest(generate_series(DATE '1994-12-26', DATE '2001-07-30', INTERVAL 7 DAY)) AS DATE) AS date),
governed AS (SELECT date, snapshot_date FROM weeks ASOF JOIN snap_days ON weeks.date >= snap_days.snapshot_date)""",
          """SELECT g.date, g.snapshot_date, 'label ' || s.model AS model, s.model AS catalog_key, cost * 1000000 AS input_usd_per_1m, CAST(NULL AS DOUBLE) AS output_usd_per_1m
FROM governed g JOIN snaps s ON s.date = g.snapshot_date WHERE cost IS NOT NULL"""),
)
def weekly_catalog_asof(spark, sf):
    points = usage_ledger(spark, sf)
    snaps = points.groupBy(F.trunc("date", "month").alias("date"), F.col("model").alias("catalog_key")).agg(F.max("price").alias("input_cost"))
    snaps = snaps.withColumn("output_cost", F.lit(None).cast("double"))
    models = points.select(F.col("model").alias("catalog_key")).distinct().withColumn("model", F.concat(F.lit("label "), F.col("catalog_key")))
    weeks = S.week_grid(spark, F.lit("1994-12-28").cast("date"), F.lit("2001-08-01").cast("date"))
    return S.weekly_catalog_asof(weeks, snaps, models)
