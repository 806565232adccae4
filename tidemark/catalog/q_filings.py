"""Filing and guidance queries over quarterly totals shaped as company filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config, schemas
from tidemark.catalog.adapters import ORDER_MODELS, QUARTERLY, quarterly, table
from tidemark.catalog.registry import query, with_
from tidemark.operators import filings as G
from tidemark.sources import readers as S

# Every nation's quarters go to one of the configured companies, in turn; of a company's nations the first is landed first.
NAMES = sorted(config.TICKER_TO_COMPANY.values())
COMPANY_SQL = f"""companies AS (SELECT n_name AS entity, n_nationkey AS place, list_extract([{', '.join(f"'{n}'" for n in NAMES)}], CAST(n_nationkey % {len(NAMES)} AS INTEGER) + 1) AS company FROM nation),
rows_q AS (SELECT company, fy, q, date, (100000 - (fy * 4 + q)) * 100 + place AS seq, value::DOUBLE AS value FROM quarterly JOIN companies USING (entity))"""


def _company_quarters(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.pmod("n_nationkey", F.lit(len(NAMES))).cast("int") + 1)
    companies = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("place"), name.alias("company"))
    return (
        quarterly(spark, sf)
        .join(companies, "entity")
        .withColumn("seq", (100000 - (F.col("fy") * 4 + F.col("q"))) * 100 + F.col("place"))
        .withColumn("value", F.col("value").cast("double"))
        .select("company", "fy", "q", "date", "seq", "value")
    )


def _capex_rows(spark, sf):
    """Actual rows, with a cumulative row beside every second quarter."""
    rows = _company_quarters(spark, sf)
    fy = F.col("fy").cast("string")
    label = F.concat(F.lit("FY"), fy, F.lit(" Q"), F.col("q").cast("string"))
    single = rows.select("company", "date", "seq", F.lit("capex actual").alias("metric"), label.alias("period"), "value")
    cumulative = rows.where("q = 2").select(
        "company", "date", (F.col("seq") - 50).alias("seq"), F.lit("capex actual").alias("metric"),
        F.concat(label, F.lit(config.CUMULATIVE_SUFFIX % 6)).alias("period"), (F.col("value") * 2).alias("value"),
    )
    return single.unionByName(cumulative)


@query(
    "calendar_quarterly", "I5, B13",
    with_(ORDER_MODELS, QUARTERLY, COMPANY_SQL, """shifted AS (SELECT company, value, seq,
  fy - CASE WHEN company = 'Microsoft' AND q <= 2 THEN 1 ELSE 0 END AS y, CASE WHEN company IN ('Microsoft', 'Oracle') THEN (q + 1) % 4 + 1 ELSE q END AS cq FROM rows_q),
named AS (SELECT right(y::VARCHAR, 2) || 'Q' || cq AS "group", company, value, seq FROM shifted)""",
          'SELECT "group", company, arg_min(value, seq) AS value FROM named GROUP BY "group", company'),
)
def calendar_quarterly(spark, sf):
    return G.calendar_quarterly(_capex_rows(spark, sf))


GUIDANCE = """named AS (SELECT company, fy, seq, date, value, CASE q WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'prev_low' ELSE 'prev_high' END AS field FROM rows_q),
fiscal AS (SELECT company, 'FY' || fy AS fiscal_year, arg_min(value, seq) FILTER (WHERE field = 'low') AS low, arg_min(value, seq) FILTER (WHERE field = 'high') AS high,
  arg_min(value, seq) FILTER (WHERE field = 'prev_low') AS prev_low, arg_min(value, seq) FILTER (WHERE field = 'prev_high') AS prev_high,
  arg_min(date, seq) FILTER (WHERE field = 'low') AS revision_date FROM named GROUP BY company, fy),
cal AS (SELECT *, row_number() OVER (PARTITION BY company, fy ORDER BY seq) AS rn FROM rows_q),
calendar AS (SELECT company, 'CY' || fy AS fiscal_year, max(value) FILTER (WHERE rn = 1) AS low, max(value) FILTER (WHERE rn = 1) AS high,
  max(value) FILTER (WHERE rn = 2) AS prev_low, max(value) FILTER (WHERE rn = 2) AS prev_high, max(date) FILTER (WHERE rn = 1) AS revision_date FROM cal GROUP BY company, fy),
buckets AS (SELECT * FROM (SELECT * FROM fiscal UNION ALL SELECT * FROM calendar) WHERE low IS NOT NULL OR high IS NOT NULL)"""


def _guidance_rows(spark, sf):
    rows = _company_quarters(spark, sf)
    fy = F.col("fy").cast("string")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("low", "high", "previous low", "previous high")]), F.col("q"))
    fiscal = rows.select("company", "date", "seq", F.concat(F.lit("fy"), fy, F.lit(" capex guidance "), kind).alias("metric"), F.lit("guidance").alias("period"), "value")
    calendar = rows.select("company", "date", "seq", F.concat(F.lit("calendar "), fy, F.lit(" capex guidance")).alias("metric"), F.lit("guidance").alias("period"), "value")
    return fiscal.unionByName(calendar)


@query("guidance_buckets", "I6, B11", with_(ORDER_MODELS, QUARTERLY, COMPANY_SQL, GUIDANCE, "SELECT * FROM buckets"))
def guidance_buckets(spark, sf):
    return G.guidance_buckets(_guidance_rows(spark, sf))


@query(
    "guidance_moves", "I7",
    with_(ORDER_MODELS, QUARTERLY, COMPANY_SQL, GUIDANCE, "k AS (SELECT * FROM buckets WHERE low IS NOT NULL AND high IS NOT NULL AND prev_low IS NOT NULL AND prev_high IS NOT NULL)",
          """SELECT company, fiscal_year, 'up' AS move FROM k WHERE low > prev_low OR high > prev_high
UNION ALL SELECT company, fiscal_year, 'down' FROM k WHERE low < prev_low OR high < prev_high"""),
)
def guidance_moves(spark, sf):
    return G.guidance_moves(G.guidance_buckets(_guidance_rows(spark, sf)))


@query(
    "latest_guidance_per_company", "I10",
    with_(ORDER_MODELS, QUARTERLY, COMPANY_SQL, GUIDANCE, """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY revision_date DESC NULLS LAST, fiscal_year) AS rn FROM buckets) WHERE rn = 1"""),
)
def latest_guidance_per_company(spark, sf):
    return G.latest_guidance_per_company(G.guidance_buckets(_guidance_rows(spark, sf)))


@query(
    "guidance_revision_low_only", "I8",
    with_(ORDER_MODELS, QUARTERLY, COMPANY_SQL, "p AS (SELECT company, arg_min(value, seq) FILTER (WHERE q = 1) AS low, arg_min(value, seq) FILTER (WHERE q = 3) AS prev_low FROM rows_q GROUP BY company)",
          "SELECT company, low, prev_low, CASE WHEN low > prev_low THEN 'up' WHEN low < prev_low THEN 'down' END AS move FROM p"),
)
def guidance_revision_low_only(spark, sf):
    return G.guidance_revision_low_only(_guidance_rows(spark, sf))


# Landed filings: one document per nation holding single and year-to-date facts under one tag.
TAG = "PaymentsToAcquirePropertyPlantAndEquipment"


def _filings(spark, sf):
    rows = quarterly(spark, sf)
    end = F.last_day(F.add_months("date", 2))
    year_start = F.trunc("date", "year")
    text = lambda c: c.cast("string")

    def fact(start, value):
        return F.struct(
            text(start).alias("start"), text(end).alias("end"), text(value).alias("val"),
            F.concat_ws("-", "entity", text(F.col("date"))).alias("accn"), text(F.col("fy")).alias("fy"),
            F.concat(F.lit("Q"), text(F.col("q"))).alias("fp"), F.lit("10-Q").alias("form"), text(F.date_add(end, 30)).alias("filed"),
        )

    facts = rows.select("entity", F.explode(F.array(fact(F.col("date"), F.col("value")), fact(year_start, F.col("value") * 2))).alias("f"))
    # A nation files two facts a quarter, so a document is bounded by the calendar.
    docs = facts.groupBy("entity").agg(F.collect_list("f").alias("rows"))
    tag = F.struct(F.lit("label").alias("label"), F.lit("text").alias("description"), F.create_map(F.lit("USD"), F.col("rows")).alias("units"))
    tags = F.create_map(F.lit(TAG), tag, F.lit("Revenues"), tag, F.lit("CapitalExpenditureOther"), tag)
    doc = F.to_json(F.struct(F.col("entity").alias("cik"), F.col("entity").alias("entityName"), F.struct(tags.alias("us-gaap")).alias("facts")))
    return docs.select(F.from_json(doc, schemas.COMPANY_FACTS).alias("d")).select("d.*")


FACTS = """base AS (SELECT entity, fy, q, date AS s, CAST(date_trunc('year', date) AS DATE) AS ys, last_day(date + INTERVAL 2 MONTH) AS e, value FROM quarterly),
raw AS (SELECT entity, fy, q, s, e, value::DOUBLE AS v FROM base UNION ALL SELECT entity, fy, q, ys, e, (value * 2)::DOUBLE FROM base),
facts AS (SELECT entity AS cik, 'USD' AS raw_unit, v AS raw_value, s::VARCHAR AS period_start, e::VARCHAR AS period_end, fy AS fiscal_year,
  (e + 30)::DATE::VARCHAR AS filed_at, CASE WHEN e - s > 130 THEN 'FY' || fy || ' Q' || q || ' 累计（约' || CAST(round((e - s) / 30.44) AS INTEGER) || '个月）' ELSE 'FY' || fy || ' Q' || q END AS fiscal_period FROM raw)"""


@query("xbrl_facts", "A16, A17", with_(ORDER_MODELS, QUARTERLY, FACTS, "SELECT * FROM facts"))
def xbrl_facts(spark, sf):
    out = S.xbrl_facts(_filings(spark, sf), F.lit(TAG))
    return out.select("cik", "raw_unit", "raw_value", "period_start", "period_end", "fiscal_year", "filed_at", "fiscal_period")


@query(
    "quarter_fact_flags", "I2",
    with_(ORDER_MODELS, QUARTERLY, FACTS, """SELECT DISTINCT cik, period_start, period_end, fiscal_period, (period_end::DATE - period_start::DATE) + 1 BETWEEN 75 AND 110 AS is_quarter FROM facts"""),
)
def quarter_fact_flags(spark, sf):
    out = G.with_quarter_flag(S.xbrl_facts(_filings(spark, sf), F.lit(TAG)))
    return out.select("cik", "period_start", "period_end", "fiscal_period", "is_quarter").distinct()


@query(
    "latest_fact", "I1",
    with_(ORDER_MODELS, QUARTERLY, FACTS, """r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC,
  ((period_end::DATE - period_start::DATE) + 1 BETWEEN 75 AND 110) DESC, filed_at DESC, period_start DESC) AS rn FROM facts)""",
          "SELECT cik, period_start, period_end, fiscal_period FROM r WHERE rn = 1"),
)
def latest_fact(spark, sf):
    out = G.latest_fact(S.xbrl_facts(_filings(spark, sf), F.lit(TAG)), "cik")
    return out.select("cik", "period_start", "period_end", "fiscal_period")


@query(
    "sequential_quarters", "I3, E14",
    with_(ORDER_MODELS, QUARTERLY, FACTS, """d AS (SELECT DISTINCT cik, period_end::DATE AS e FROM facts WHERE (period_end::DATE - period_start::DATE) + 1 BETWEEN 75 AND 110),
g AS (SELECT cik, e, lag(e) OVER (PARTITION BY cik ORDER BY e DESC) - e AS gap FROM d),
b AS (SELECT cik, sum(CASE WHEN gap IS NULL OR gap BETWEEN 80 AND 100 THEN 0 ELSE 1 END) OVER (PARTITION BY cik ORDER BY e DESC) AS breaks FROM g)""",
          """SELECT cik, count(*) FILTER (WHERE breaks = 0) AS sequential_quarter_count, count(*) FILTER (WHERE breaks = 0) >= 4 AS can_evaluate_trend FROM b GROUP BY cik"""),
)
def sequential_quarters(spark, sf):
    return G.sequential_quarters(S.xbrl_facts(_filings(spark, sf), F.lit(TAG)), "cik")


@query(
    "capex_observation", "I4, B21",
    with_(ORDER_MODELS, QUARTERLY, FACTS, """SELECT 'T' || replace(cik, 'NATION_', '') AS ticker, period_start, period_end, fiscal_period, abs(raw_value) / 1e9 AS capex_value,
  'USD_B' AS unit, 'sec-companyfacts-CIK' || cik || '-PaymentsToAcquirePropertyPlantAndEquipment' AS source_id, filed_at || 'T00:00:00Z' AS observed_at FROM facts"""),
)
def capex_observation(spark, sf):
    nation = F.col("n_name")
    companies = table(spark, sf, "nation").select(
        F.concat(F.lit("T"), F.replace(nation, F.lit("NATION_"), F.lit(""))).alias("ticker"), nation.alias("company"), nation.alias("cik"), F.lit(TAG).alias("xbrl_tag")
    )
    facts = S.xbrl_facts(_filings(spark, sf), F.lit(TAG))
    out = G.capex_observation(facts, companies, F.lit("run1"), F.lit("2024-01-01T00:00:00Z"))
    return out.select("ticker", "period_start", "period_end", "fiscal_period", "capex_value", "unit", "source_id", "observed_at")


@query(
    "candidate_tags", "I9",
    with_(ORDER_MODELS, QUARTERLY, "SELECT DISTINCT entity AS cik, 'CapitalExpenditureOther,PaymentsToAcquirePropertyPlantAndEquipment' AS tags FROM quarterly"),
)
def candidate_tags(spark, sf):
    out = G.candidate_tags(_filings(spark, sf), "facts.us-gaap")
    return out.withColumn("tags", F.array_join("tags", ","))
