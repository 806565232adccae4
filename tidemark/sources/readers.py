"""Landed raw documents to typed rows.

Readers take a path; parsers take an already loaded DataFrame with the matching schema from
:mod:`tidemark.schemas`. Each document is one row until its arrays are exploded, so documents
spread over tasks and their entries are filtered before anything is grouped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config, schemas
from tidemark.functions.scalars import (
    array_median,
    classify_first_match,
    lookup,
    parse_day,
    parse_weekday_date,
    per_million,
    positive,
    venue_grade,
)
from tidemark.operators.filings import fiscal_label
from tidemark.operators.joins import asof_join
from tidemark.operators.ordered import first_per_key, last_per_key


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents with a declared schema; a missing path is an empty set."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_rows(spark: SparkSession, path: str, row_schema: str, field: str = "rows") -> DataFrame:
    """Rows of a versioned document: ``rows`` or ``datasets.<name>``."""
    parts = field.split(".")
    inner = f"array<struct<{row_schema}>>"
    schema = f"{parts[0]} {inner}" if len(parts) == 1 else f"{parts[0]} struct<`{parts[1]}`: {inner}>"
    docs = read_documents(spark, path, schema)
    column = F.col(parts[0]) if len(parts) == 1 else F.col(parts[0])[parts[1]]
    return docs.select(F.inline(column))


def offers_marketplace_a(df: DataFrame, family: str | None = None) -> DataFrame:
    """Available USD offers with a positive price; currency defaults to USD, GPU count to 1."""
    o = F.col("_o")
    exploded = df.select("date", F.col("pagination.total").alias("server_total"), F.explode("data").alias("_o"))
    name = F.concat_ws(" ", F.coalesce(o["gpu"]["slug"], F.lit("")), F.coalesce(o["gpu"]["name"], F.lit("")))
    currency = F.upper(F.coalesce(F.nullif(o["currency"], F.lit("")), F.lit("USD")))
    rows = exploded.where(o["isAvailable"] & (currency == "USD")).select(
        "date",
        classify_first_match(name, config.FAMILY_RULES_ORDER_BOOK, "unknown").alias("series"),
        positive(o["pricePerGpu"]).alias("price"),
        F.coalesce(F.nullif(o["gpuCount"], F.lit(0)), F.lit(1)).cast("long").alias("gpus"),
        F.coalesce(F.nullif(o["provider"], F.lit("")), F.lit("unknown")).alias("provider"),
        F.coalesce("server_total", F.lit(0)).alias("server_total"),
    )
    kept = rows.where("price IS NOT NULL")
    return kept if family is None else kept.where(F.col("series") == family)


def offers_marketplace_b(df: DataFrame, focus: Sequence[str]) -> DataFrame:
    """Verified rentable offers of the focus families at a per-GPU price."""
    o = F.col("_o")
    exploded = df.select("date", F.explode("offers").alias("_o"))
    open_offer = o["rentable"] & ~F.coalesce(o["rented"], F.lit(False)) & (F.lower(o["verification"]) == "verified")
    gpus = o["num_gpus"].try_cast("long")
    return (
        exploded.where(open_offer)
        .select(
            "date",
            classify_first_match(o["gpu_name"], config.FAMILY_RULES_ORDER_BOOK, "unknown").alias("series"),
            F.try_divide(positive(o["dph_total"]), gpus).alias("price"),
            gpus.alias("gpus"),
        )
        .where(F.col("series").isin(list(focus)) & F.col("price").isNotNull() & (F.col("gpus") != 0))
    )


def offers_tiered(df: DataFrame, focus: Sequence[str]) -> DataFrame:
    """Model-level listings without fractional cards at the cheaper enabled tier."""
    g = F.col("_g")
    exploded = df.select("date", F.explode("data.gpuTypes").alias("_g"))
    identity = F.concat_ws(" ", F.coalesce(g["id"], F.lit("")), F.coalesce(g["displayName"], F.lit("")))
    secure = F.when(g["secureCloud"], positive(g["securePrice"]))
    community = F.when(g["communityCloud"], positive(g["communityPrice"]))
    return (
        exploded.where(~F.contains(F.lower(identity), F.lit("mig")))
        .select(
            "date",
            classify_first_match(identity, config.FAMILY_RULES_ORDER_BOOK, "unknown").alias("series"),
            F.least(secure, community).alias("price"),
            g["maxGpuCount"].cast("long").alias("gpus"),
        )
        .where(F.col("series").isin(list(focus)) & F.col("price").isNotNull())
    )


def provider_offers(df: DataFrame, default_url: str | None = None) -> DataFrame:
    """Cleaned provider listings: positive prices at 6 decimals, graded venues; of exact repeats the first listed stays."""
    o = F.col("_o")
    clean = lambda c, default: F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(default))))
    rows = df.select(F.substring("date", 1, 10).alias("date"), F.posexplode("offers").alias("_place", "_o")).select(
        "date",
        clean(o["provider"], "unknown").alias("provider"),
        F.coalesce(classify_first_match(F.nullif(F.trim(o["gpu"]), F.lit("")), config.FAMILY_RULES_PROVIDER), F.lit("unknown")).alias("series"),
        o["vram_gb"].alias("vram_gb"),
        clean(o["kind"], "unknown").alias("kind"),
        F.round(positive(o["usd_hr"]), 6).alias("usd_per_gpu_hour"),
        F.coalesce(F.nullif(o["source_url"], F.lit("")), F.lit(default_url)).alias("source_url"),
        "_place",
    )
    keys = ["date", "provider", "series", "vram_gb", "kind", "usd_per_gpu_hour"]
    listed = first_per_key(rows.where("usd_per_gpu_hour IS NOT NULL"), keys, ["_place"], ["source_url"])
    return listed.withColumn("venue_grade", venue_grade("provider"))


def index_history(df: DataFrame) -> DataFrame:
    """Daily index points with a positive value, the first of a (day, series) kept."""
    p = F.col("_p")
    rows = df.where("success").select(
        F.col("gpu").alias("series"), F.posexplode("data").alias("_seq", "_p")
    ).where((F.length(p["timestamp"]) >= 10) & (p["index_value"] > 0)).select(
        F.substring(p["timestamp"], 1, 10).alias("date"), "series", p["index_value"].alias("index_value"), "_seq"
    )
    return (
        first_per_key(rows, ["date", "series"], ["_seq"])
        .drop("_seq")
        .withColumns({"unit": F.lit("USD/GPU-hr"), "basis": F.lit("transaction_index")})
    )


def realized_price(df: DataFrame) -> DataFrame:
    """Realized unit price per lab and full day."""
    return (
        df.where("success")
        .select(F.inline("data"))
        .where((F.length("date") == 10) & (F.coalesce("lab", F.lit("")) != "") & (F.col("indexPerMtok") > 0))
        .select(
            "date",
            F.col("lab").alias("series"),
            F.col("indexPerMtok").alias("index_value"),
            F.lit("USD/Mtok").alias("unit"),
            F.lit("realized_token_price").alias("basis"),
        )
    )


def wide_index_to_long(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """One row per (day, column) with a positive value; days come as weekday dates."""
    wide = df.select(F.inline("index")).withColumn("_day", parse_weekday_date("date"))
    cells = F.array(*[F.struct(F.lit(name).alias("series"), F.col(c).alias("index_value")) for c, name in cols.items()])
    return (
        wide.where("_day IS NOT NULL")
        .select(F.col("_day").alias("date"), F.inline(cells))
        .where(F.col("index_value") > 0)
    )


def contract_bands(df: DataFrame, prefix: str = "H100-") -> DataFrame:
    """Every two-number array of a survey item is a tenor band; items are JSON object strings."""
    items = df.select(F.explode("contract").alias("_b")).select(F.explode("_b.data").alias("_json"))
    fields = items.select("_json", F.from_json("_json", "map<string,string>").alias("_m")).select(
        F.col("_m")["period"].alias("label"), F.col("_m")["period_start"].alias("_start"), F.explode("_m").alias("_tenor", "_raw")
    )
    band = fields.withColumn("_band", F.from_json("_raw", "array<double>")).where(
        F.startswith(F.trim("_raw"), F.lit("[")) & (F.size("_band") == 2)
    )
    low, high = F.col("_band")[0], F.col("_band")[1]
    return band.where((low > 0) & (high > 0)).select(
        F.coalesce(parse_weekday_date("_start").cast("string"), F.lit("")).alias("date"),
        F.concat(F.lit(prefix), F.col("_tenor")).alias("series"),
        low.alias("low_value"),
        high.alias("high_value"),
        F.coalesce("label", F.lit("")).alias("label"),
    )


def change_point_ledger(df: DataFrame) -> DataFrame:
    """Valid three-part points per model in stable day order; ``seq`` keeps the landed order."""
    models = df.select(F.explode("models").alias("model", "_r"))
    return models.select(
        "model",
        F.coalesce("_r.name", F.col("model")).alias("name"),
        F.col("_r.first_seen").alias("_fs"),
        F.col("_r.last_seen").alias("_ls"),
        F.coalesce("_r.present_now", F.lit(False)).alias("present_now"),
        F.filter("_r.points", lambda p: (F.size(p) == 3) & (F.coalesce(p[0], F.lit("")) != "")).alias("_pts"),
    ).where(F.size("_pts") > 0).select(
        "model",
        "name",
        F.coalesce("_fs", F.col("_pts")[0][0]).alias("first_seen"),
        F.coalesce("_ls", F.element_at("_pts", -1)[0]).alias("last_seen"),
        "present_now",
        F.posexplode("_pts").alias("seq", "_p"),
    ).select(
        "model", "name", "first_seen", "last_seen", "present_now", "seq",
        parse_day(F.col("_p")[0]).alias("date"),
        F.col("_p")[1].try_cast("double").alias("input"),
        F.col("_p")[2].try_cast("double").alias("output"),
    )


def current_catalog(df: DataFrame) -> DataFrame:
    """Listed models with per-million prices; ``seq`` is the position in the catalog."""
    return (
        df.select(F.posexplode("data").alias("seq", "_m"))
        .where(F.coalesce("_m.id", F.lit("")) != "")
        .select(
            "seq",
            F.col("_m.id").alias("id"),
            F.col("_m.canonical_slug").alias("canonical_slug"),
            F.coalesce(F.nullif(F.col("_m.name"), F.lit("")), F.col("_m.id")).alias("name"),
            per_million("_m.pricing.prompt").alias("input_usd_per_1m"),
            per_million("_m.pricing.completion").alias("output_usd_per_1m"),
        )
    )


def alias_map(catalog: DataFrame) -> DataFrame:
    """id -> id and canonical slug -> id; a later entry wins."""
    pairs = catalog.select("seq", "id", F.posexplode(F.array("id", "canonical_slug")).alias("_k", "alias")).where(
        F.coalesce("alias", F.lit("")) != ""
    )
    return last_per_key(pairs, ["alias"], ["seq", "_k"], ["id"]).select("alias", F.col("id").alias("target"))


def provider_map_prices(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Median, range and count of the positive provider prices of every landed point.

    A point's prices sit in its own map, so the median is taken inside the row.
    """
    points = (
        df.select(F.explode("data").alias("_name", "_pts"))
        .withColumn("series", lookup("_name", names))
        .where("series IS NOT NULL")
        .select("series", F.inline("_pts"))
        .withColumn("_prices", F.map_filter("provider_prices", lambda _, v: v > 0))
        .where((F.coalesce("date", F.lit("")) != "") & F.col("avg_price").isNotNull() & (F.size("_prices") > 0))
    )
    return points.select(
        "date",
        "series",
        array_median(F.map_values("_prices")).alias("value"),
        F.col("avg_price").alias("average"),
        F.col("min_price").alias("low"),
        F.col("max_price").alias("high"),
        F.size("_prices").alias("provider_count"),
    )


def availability_cells(df: DataFrame) -> DataFrame:
    """One row per (gpu, provider, day): available and total over every day of the landed window."""
    name = F.coalesce(
        F.nullif(F.col("_p.providerName"), F.lit("")), F.nullif(F.col("_p.providerSlug"), F.lit("")), F.lit("unknown")
    )
    return (
        df.select("gpu", F.explode("providers").alias("_p"))
        .select("gpu", name.alias("provider"), F.explode("_p.counts").alias("_c"))
        .select("gpu", "provider", F.inline("_c.cells"))
        .where((F.coalesce("date", F.lit("")) != "") & (F.col("total") > 0))
        .groupBy("gpu", "date", "provider")
        .agg(F.sum(F.coalesce("available", F.lit(0.0))).alias("available"), F.sum("total").alias("total"))
    )


def availability_days(cells: DataFrame) -> DataFrame:
    """Ratio of sums per day with the provider map; a day has at most one entry per provider."""
    entry = F.struct(F.col("provider"), F.array(F.col("available"), F.col("total")))
    return cells.groupBy("gpu", "date").agg(
        (F.lit(100) * F.sum("available") / F.sum("total")).alias("availability_pct"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("availability_by_provider"),
    )


def price_gap(listed: Column, available: Column) -> Column:
    """Cheapest available over cheapest listed, in percent; only when both are numbers."""
    return F.when(available.isNotNull() & (listed > 0), (F.try_divide(available, listed) - 1) * 100)


def monthly_history(df: DataFrame, seq: Column | None = None) -> DataFrame:
    """Month x gpu x provider prices; the last landed row of a key wins."""
    rows = df.select("gpu", (seq if seq is not None else F.lit(0)).alias("_doc"), F.posexplode("history").alias("_pos", "_h")).select(
        "gpu",
        F.col("_h.month").alias("month"),
        F.col("_h.provider").alias("provider"),
        F.col("_h.onDemandPrice").alias("on_demand_price"),
        F.col("_h.spotPrice").alias("spot_price"),
        "_doc",
        "_pos",
    )
    return last_per_key(rows, ["month", "gpu", "provider"], ["_doc", "_pos"]).drop("_doc", "_pos")


def xbrl_facts(df: DataFrame, tag: Column) -> DataFrame:
    """Complete numeric facts of each company's tag, with the fiscal label that matches their length."""
    facts = (
        df.withColumn("_tag", F.try_element_at(F.col("facts.us-gaap"), tag))
        .select("cik", "entityName", F.explode("_tag.units").alias("raw_unit", "_rows"))
        .select("cik", "entityName", "raw_unit", F.inline("_rows"))
    )
    stated = " AND ".join(
        f"coalesce(`{c}`, '') <> ''" for c in ("start", "end", "val", "accn", "fy", "fp", "form", "filed")
    )
    typed = facts.where(stated).select(
        "cik",
        "entityName",
        "raw_unit",
        F.col("val").try_cast("double").alias("raw_value"),
        F.col("start").alias("period_start"),
        F.col("end").alias("period_end"),
        F.col("fy").try_cast("int").alias("fiscal_year"),
        "fp",
        F.col("accn").alias("accession_no"),
        F.col("filed").alias("filed_at"),
        F.col("form").alias("form_type"),
    )
    label = fiscal_label(F.col("fiscal_year"), F.col("fp"), parse_day("period_start"), parse_day("period_end"))
    return typed.where("raw_value IS NOT NULL AND fiscal_year IS NOT NULL").withColumn("fiscal_period", label)


def chip_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """The eight kept columns, trimmed, blank as null; start day and unit count are required."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    numbers = ("Number of Units", "Compute estimate in H100e (median)")
    columns = []
    for c in schemas.CHIP_SALES:
        text = F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
        columns.append((text.try_cast("double") if c in numbers else text).alias(c))
    kept = raw.select(*columns).where(F.col("`Start date`").isNotNull() & F.col("`Number of Units`").isNotNull())
    return kept.orderBy("Start date", F.coalesce("Name", F.lit("None")))


def macro_series_csv(spark: SparkSession, path: str, keep_from: str) -> DataFrame:
    """(day, value) pairs on or after ``keep_from``; blank values are skipped."""
    raw = spark.read.option("header", True).schema("date string, value string").csv(path)
    return raw.where(
        (F.coalesce("value", F.lit("")) != "") & (F.col("date") >= keep_from)
    ).select("date", F.col("value").try_cast("double").alias("value"))


def text_field(block: Column, name: str, number: bool = False) -> Column:
    """Value of the first ``name: value`` of a block, quoted text or a number; null if it has none."""
    value = r"(-?[0-9.]+)" if number else r"'([^']+)'"
    return F.nullif(F.regexp_extract(block, rf"\b{name}:\s*{value}", 1), F.lit(""))


def fixings_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Published fixings found in source text, with the chip name joined by id."""
    # A block runs from one opening brace with an id to the next.
    parts = df.select("date", F.posexplode(F.split(text, r"(?=\{\s*id:\s*')")).alias("_pos", "_b"))
    b = F.col("_b")
    fields = parts.select(
        "date",
        "_pos",
        text_field(b, "id").alias("series_id"),
        text_field(b, "tenor").alias("tenor"),
        text_field(b, "price", True).try_cast("double").alias("price"),
        text_field(b, "obs", True).try_cast("long").alias("obs_count"),
        text_field(b, "venueCount").alias("venue_count"),
        text_field(b, "delta30d", True).try_cast("double").alias("delta_30d_pct"),
        text_field(b, "chipName").alias("chip"),
    ).where("series_id IS NOT NULL")
    priced = F.col("tenor").isNotNull() & F.col("price").isNotNull() & F.col("obs_count").isNotNull() & F.col("venue_count").isNotNull()
    rows = fields.where(priced).drop("_pos", "chip")
    chips = last_per_key(fields.where("chip IS NOT NULL"), ["date", "series_id"], ["_pos"], ["chip"])
    return rows.join(chips, ["date", "series_id"], "left").withColumn("chip", F.coalesce("chip", F.lit("")))


def weekly_usage_map(df: DataFrame, residual: str = "Others") -> DataFrame:
    """(week, model, provider prefix, tokens) from a map keyed by model."""
    points = df.select(F.inline("data.data")).select("x", F.explode("ys").alias("model", "tokens"))
    provider = F.when(F.col("model") == residual, residual).otherwise(F.substring_index("model", "/", 1))
    return points.select(parse_day("x").alias("date"), "model", provider.alias("provider"), "tokens")


def benchmarks_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cited throughput rows as landed, beside the published formula text."""
    docs = read_documents(spark, path, schemas.THROUGHPUT)
    return docs.select(F.coalesce("formula", F.lit("")).alias("formula"), F.explode("rows").alias("row"))


def official_events(df: DataFrame) -> DataFrame:
    """Single values stay one row; a bound object becomes one row per stated bound."""
    bounds = ["low", "high", "previous_low", "previous_high"]
    parsed = df.withColumn("_b", F.from_json("value", ", ".join(f"{b} double" for b in bounds)))
    is_band = F.startswith(F.trim("value"), F.lit("{"))
    single = F.array(F.struct(F.col("metric").alias("metric"), F.col("value").try_cast("double").alias("value")))
    band = F.array(
        *[F.struct(F.concat("metric", F.lit(f"_{b}")).alias("metric"), F.col(f"_b.{b}").alias("value")) for b in bounds]
    )
    others = [c for c in df.columns if c not in ("metric", "value")]
    return (
        parsed.select(*others, F.explode(F.when(is_band, band).otherwise(single)).alias("_r"))
        .select(*others, "_r.metric", "_r.value")
        .where("value IS NOT NULL")
    )


def daily_archive(spark: SparkSession, path: str) -> DataFrame:
    """One map document per day, the day taken from the file name."""
    docs = spark.read.text(path, wholetext=True)
    day = F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.json", 1)
    return docs.select(
        parse_day(day).alias("date"), F.explode(F.from_json("value", "map<string,double>")).alias("model", "tokens")
    )


def week_grid(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """Mondays from the week of ``start`` to the week of ``end``."""
    monday = lambda c: F.date_trunc("week", c).cast("date")
    return spark.range(1).select(
        F.explode(F.sequence(monday(start), monday(end), F.expr("INTERVAL 7 DAYS"))).alias("date")
    )


def weekly_catalog_asof(weeks: DataFrame, snaps: DataFrame, models: DataFrame) -> DataFrame:
    """Prices of chosen catalog keys each week from the latest snapshot on or before it.

    ``snaps(date, catalog_key, input_cost, output_cost)`` is exploded once per snapshot; a key absent
    from the governing snapshot stays missing rather than reaching back further.
    """
    days = snaps.select("date").distinct().withColumn("snapshot_date", F.col("date"))
    governed = asof_join(weeks, days, [], "date", ["snapshot_date"]).where("snapshot_date IS NOT NULL")
    prices = snaps.withColumnRenamed("date", "snapshot_date").join(models, "catalog_key")
    return governed.join(prices, "snapshot_date").where(
        "input_cost IS NOT NULL OR output_cost IS NOT NULL"
    ).select(
        "date",
        "snapshot_date",
        "model",
        "catalog_key",
        (F.col("input_cost") * 1_000_000).alias("input_usd_per_1m"),
        (F.col("output_cost") * 1_000_000).alias("output_usd_per_1m"),
    )


def dated_events(spark: SparkSession, path: str) -> DataFrame:
    """Annotation events with a day and a label; an unreadable file is an empty set."""
    docs = read_documents(spark, path, schemas.DATED_EVENTS)
    return docs.where((F.coalesce("date", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))
