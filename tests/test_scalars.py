"""Column functions on literal cases."""

from pyspark.sql import functions as F

from tests.helpers import d, one, rows
from tidemark import config
from tidemark.functions import scalars as S


def test_families_in_order(spark):
    df = spark.createDataFrame([("h100-sxm-80gb",), ("RTX_5090",), ("mystery-gpu",), ("NVIDIA GH200",)], "t string")
    book = S.classify_first_match("t", config.FAMILY_RULES_ORDER_BOOK, "unknown")
    assert [r[0] for r in df.select(book).collect()] == ["H100", "RTX 5090", "unknown", "GH200"]
    kept = S.classify_first_match("t", config.FAMILY_RULES_PROVIDER)
    assert [r[0] for r in df.select(kept).collect()][2] == "mystery-gpu"


def test_frontier_rules_keep_separators(spark):
    df = spark.createDataFrame([("a-100",), ("A100 80GB",)], "t string")
    c = S.classify_first_match("t", config.FAMILY_RULES_FRONTIER, fold_separators=False)
    assert [r[0] for r in df.select(c).collect()] == ["a-100", "A100"]


def test_positive_and_finite(spark):
    df = spark.createDataFrame([("0",), ("-1.5",), ("abc",), (None,), ("2.5",), ("NaN",), ("Infinity",)], "t string")
    assert [r[0] for r in df.select(S.positive("t")).collect()] == [None, None, None, None, 2.5, None, float("inf")]
    assert [r[0] for r in df.select(S.finite("t")).collect()] == [0.0, -1.5, None, None, 2.5, None, None]


def test_days_never_fail(spark):
    df = spark.createDataFrame([("2026-07-06T10:00:00Z",), ("2026-02-30",), ("soon",), (None,), ("2026-07-06 09:00",)], "t string")
    assert [r[0] for r in df.select(S.parse_day("t")).collect()] == [d("2026-07-06"), None, None, None, d("2026-07-06")]
    assert [r[0] for r in df.select(S.day_of("t")).collect()][0] == "2026-07-06"
    weekday = spark.createDataFrame([("Mon, 03 Aug 2026 00:00:00 GMT",), ("Aug 3",)], "t string")
    assert [r[0] for r in weekday.select(S.parse_weekday_date("t")).collect()] == [d("2026-08-03"), None]


def test_tiers_at_boundaries(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.99,), (1.0,), (5.0,), (5.01,)], "p double")
    got = [r[0] for r in df.select(S.price_tier("p")).collect()]
    assert got == ["unmatched", "free", "under_1", "1_to_5", "1_to_5", "over_5"]


def test_names(spark):
    df = spark.createDataFrame([("vendor/model-x-preview-20250101",), ("plain",), ("v/" + "m" * 40,)], "t string")
    assert [r[0] for r in df.select(S.short_name("t")).collect()] == ["model-x", "plain", "m" * 33 + "..."]
    names = spark.createDataFrame([("v/m-20250101:free",)], "t string").select(S.name_candidates("t"))
    assert one(names)[0] == [
        "openrouter/v/m-20250101:free", "openrouter/v/m-20250101", "openrouter/v/m",
        "v/m-20250101:free", "v/m-20250101", "v/m", "m",
    ]


def test_guidance_and_fiscal_labels(spark):
    df = spark.createDataFrame(
        [("fy2026 capex guidance low",), ("fy2026 capex guidance previous high",), ("calendar 2026 capex guidance",), ("cloud backlog",)],
        "m string",
    )
    got = [tuple(r[0]) if r[0] else None for r in df.select(S.guidance_metric("m")).collect()]
    assert got == [("FY2026", "low"), ("FY2026", "prev_high"), ("CY2026", "calendar"), None]
    labels = spark.createDataFrame([("FY2026 Q2",), ("FY2026 Q2 累计（约6个月）",), ("FY2026",)], "p string")
    assert [tuple(r[0]) if r[0] else None for r in labels.select(S.fiscal_quarter("p")).collect()] == [(2026, 2), None, None]


def test_calendar_groups(spark):
    df = spark.createDataFrame(
        [("Microsoft", 2026, 3), ("Microsoft", 2026, 1), ("Oracle", 2026, 1), ("Meta", 2026, 2), ("Other", 2026, 1)], "c string, fy int, q int"
    )
    assert [r[0] for r in df.select(S.calendar_group("c", "fy", "q")).collect()] == ["26Q1", "25Q3", "26Q3", "26Q2", None]


def test_complete_period_is_strict(spark):
    df = spark.createDataFrame([(d("2026-07-06"),), (d("2026-07-13"),), (d("2026-07-08"),)], "w date")
    as_of = F.lit("2026-07-14").cast("date")
    assert [r[0] for r in df.select(S.complete_period("w", as_of)).collect()] == [True, False, False]
    assert [r[0] for r in df.select(S.complete_period("w", as_of, inclusive=True)).collect()] == [True, False, True]


def test_identity_ignores_run_metadata(spark):
    df = spark.createDataFrame([("t", "s", "r1"), ("t", "s", "r2")], "track string, source string, run string")
    ids = {r[0] for r in df.select(S.series_id("track", "source")).collect()}
    assert len(ids) == 1


def test_array_median(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(S.array_median("v")).collect()] == [2.0, 2.5, None]


def test_wide_rows_to_long(spark):
    df = spark.createDataFrame([("2026-01-01", "H100", 1.5, None), ("2026-1-1", "H100", 2.0, 1.0)], "date string, gpu string, a double, b double")
    out = S.indicators_to_long(df, "date", "gpu", ["H100"], {"a": "scarcity", "b": "gap"})
    assert rows(out, "dataset", "value") == [("scarcity", 1.5)]
