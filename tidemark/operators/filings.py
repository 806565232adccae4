"""Company filings: facts, fiscal labels, quarterly runs and guidance revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.scalars import calendar_group, fiscal_quarter, guidance_metric, parse_day, usd_billions
from tidemark.operators.ordered import first_per_key, last_per_key
from tidemark.operators.series import latest_sequential_run


def fiscal_label(fy: Column, fp: Column, start: Column, end: Column) -> Column:
    """``FY2026 Q2``, with a cumulative suffix when the fact spans more than four months."""
    period = F.upper(F.trim(fp))
    base = F.when(period == "FY", F.format_string("FY%d", fy)).otherwise(F.format_string("FY%d %s", fy, period))
    months = F.bround(F.date_diff(end, start) / 30.44, 0).cast("int")
    suffix = F.when(months > 4, F.format_string(config.CUMULATIVE_SUFFIX, months)).otherwise(F.lit(""))
    return F.concat(base, F.coalesce(suffix, F.lit("")))


def is_quarter_fact(start: Column, end: Column, label: Column) -> Column:
    days = F.date_diff(end, start) + 1
    return F.coalesce(days.between(75, 110) & F.contains(label, F.lit(" Q")), F.lit(False))


def with_quarter_flag(facts: DataFrame) -> DataFrame:
    start, end = parse_day("period_start"), parse_day("period_end")
    return facts.withColumn("is_quarter", is_quarter_fact(start, end, F.col("fiscal_period")))


def latest_fact(facts: DataFrame, entity: str) -> DataFrame:
    """Newest period per entity; a single quarter beats a cumulative row ending the same day."""
    order = ["period_end", "is_quarter", "filed_at", "period_start"]
    return last_per_key(with_quarter_flag(facts), [entity], order)


def sequential_quarters(facts: DataFrame, entity: str) -> DataFrame:
    """Length of the regular quarter run back from the latest, and whether a trend may be judged."""
    quarters = with_quarter_flag(facts).where("is_quarter").withColumn("_end", parse_day("period_end"))
    runs = latest_sequential_run(quarters, [entity], "_end")
    everyone = facts.select(entity).distinct()
    run = F.coalesce("run", F.lit(0))
    return everyone.join(runs, entity, "left").select(
        entity, run.alias("sequential_quarter_count"), (run >= 4).alias("can_evaluate_trend")
    )


def capex_observation(facts: DataFrame, companies: DataFrame, run_id: Column, fetched_at: Column) -> DataFrame:
    """Filing facts joined to their company configuration as USD billions with provenance.

    ``companies`` is the small configured universe (ticker, company, cik, xbrl_tag).
    """
    source = F.concat(F.lit("sec-companyfacts-CIK"), F.col("cik"), F.lit("-"), F.col("xbrl_tag"))
    return facts.join(companies, "cik").select(
        "ticker",
        "company",
        "period_start",
        "period_end",
        "fiscal_period",
        "fiscal_year",
        "xbrl_tag",
        "accession_no",
        usd_billions("raw_value").alias("capex_value"),
        F.lit("USD_B").alias("unit"),
        "filed_at",
        "form_type",
        run_id.alias("run_id"),
        source.alias("source_id"),
        F.lit("official").alias("source_type"),
        F.lit("sec_companyfacts_api").alias("collection_method"),
        F.concat(F.col("filed_at"), F.lit("T00:00:00Z")).alias("observed_at"),
        fetched_at.alias("fetched_at"),
        F.lit(True).alias("is_production_eligible"),
        F.lit(1.0).alias("confidence"),
    )


def calendar_quarterly(rows: DataFrame) -> DataFrame:
    """Single-quarter actuals by calendar quarter and company; ``seq`` 0 is the newest row and wins."""
    label = fiscal_quarter("period")
    placed = (
        rows.where((F.col("metric") == "capex actual") & F.col("value").isNotNull())
        .withColumn("_q", label)
        .withColumn("group", calendar_group("company", "_q.fy", "_q.q"))
        .where("`group` IS NOT NULL")
    )
    return first_per_key(placed.select("group", "company", "seq", "value"), ["group", "company"], ["seq"]).select(
        "group", "company", "value"
    )


def guidance_buckets(rows: DataFrame) -> DataFrame:
    """Current and previous bounds per (company, fiscal or calendar year).

    ``seq`` 0 is the newest row. A stated bound is taken from its newest row; a calendar year's
    single value sets both bounds and the next older one becomes the previous pair. Only mapped
    companies and single-period rows count.
    """
    parsed = (
        rows.where(
            F.col("value").isNotNull()
            & F.col("company").isin(list(config.FISCAL_TO_CALENDAR))
            & ~F.contains(F.coalesce("period", F.lit("")), F.lit(config.CUMULATIVE_MARK))
        )
        .withColumn("_g", guidance_metric("metric"))
        .where("_g IS NOT NULL")
        .select("company", F.col("_g.bucket").alias("fiscal_year"), F.col("_g.field").alias("field"), "seq", "date", "value")
    )
    keys = ["company", "fiscal_year"]
    newest = parsed.where("field <> 'calendar'").groupBy(*keys, "field").agg(
        F.min_by(F.struct("value", "date"), "seq").alias("_v")
    )
    stated = newest.groupBy(*keys).pivot("field", ["low", "high", "prev_low", "prev_high"]).agg(F.first("_v"))
    fiscal = stated.select(
        *keys,
        F.col("low.value").alias("low"),
        F.col("high.value").alias("high"),
        F.col("prev_low.value").alias("prev_low"),
        F.col("prev_high.value").alias("prev_high"),
        F.col("low.date").alias("revision_date"),
    )
    ranked = (
        parsed.where("field = 'calendar'")
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
        .where("_rn <= 2")
    )
    first, second = F.col("_rn") == 1, F.col("_rn") == 2
    current, prior = F.max(F.when(first, F.col("value"))), F.max(F.when(second, F.col("value")))
    calendar = ranked.groupBy(*keys).agg(
        current.alias("low"),
        current.alias("high"),
        prior.alias("prev_low"),
        prior.alias("prev_high"),
        F.max(F.when(first, F.col("date"))).alias("revision_date"),
    )
    return fiscal.unionByName(calendar).where("low IS NOT NULL OR high IS NOT NULL")


def guidance_moves(buckets: DataFrame) -> DataFrame:
    """Companies whose band moved up, down or both: one row per (company, year, move)."""
    known = buckets.where("low IS NOT NULL AND high IS NOT NULL AND prev_low IS NOT NULL AND prev_high IS NOT NULL")
    up = F.when((F.col("low") > F.col("prev_low")) | (F.col("high") > F.col("prev_high")), "up")
    down = F.when((F.col("low") < F.col("prev_low")) | (F.col("high") < F.col("prev_high")), "down")
    return known.select("company", "fiscal_year", F.explode(F.array_compact(F.array(up, down))).alias("move"))


def guidance_revision_low_only(rows: DataFrame) -> DataFrame:
    """Per company, the first stated low against the first stated previous low, whatever the year."""
    metric = F.col("metric")
    field = (
        F.when(F.contains(metric, F.lit("previous low")), "prev_low")
        .when(F.contains(metric, F.lit("previous high")), "prev_high")
        .when(F.endswith(metric, F.lit("guidance low")), "low")
        .when(F.endswith(metric, F.lit("guidance high")), "high")
    )
    stated = (
        rows.where(F.contains(F.lower(metric), F.lit("guidance")) & F.col("value").isNotNull())
        .withColumn("_field", field)
        .where("_field IS NOT NULL")
    )
    at = lambda name: F.min_by("value", F.when(F.col("_field") == name, F.col("seq")))
    pairs = stated.groupBy("company").agg(at("low").alias("low"), at("prev_low").alias("prev_low"))
    move = F.when(F.col("low") > F.col("prev_low"), "up").when(F.col("low") < F.col("prev_low"), "down")
    return pairs.withColumn("move", move)


def candidate_tags(payloads: DataFrame, facts: str = "us_gaap") -> DataFrame:
    """Spending-related tags of a filing, sorted; ``facts`` is a map keyed by tag."""
    tags = F.filter(
        F.map_keys(facts),
        lambda k: F.contains(k, F.lit("PaymentsToAcquire")) | F.contains(k, F.lit("CapitalExpenditure")),
    )
    return payloads.select("cik", F.array_sort(tags).alias("tags"))


def latest_guidance_per_company(buckets: DataFrame) -> DataFrame:
    """The year bucket with the newest revision per company; the earlier bucket on equal dates."""
    newest = F.min_by(
        F.struct(*buckets.columns),
        F.struct(-F.unix_date(F.coalesce("revision_date", F.lit("1900-01-01").cast("date"))), F.col("fiscal_year")),
    )
    return buckets.groupBy("company").agg(newest.alias("_b")).select("_b.*")
