"""Every branch of the clocks, from metric rows and from small panels."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import d, days, one, rows
from tidemark.operators import series as S
from tidemark.plans import states as P


def _row(spark, names, **values):
    schema = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([tuple(None if values.get(n, 0) is None else float(values.get(n, 0)) for n in names)], schema)


READY = dict(panels=6, chart_ready_panels=6, depth_valid_dates=30)


@pytest.mark.parametrize(
    "values, state, direction",
    [
        (dict(), "Unobservable", None),
        (dict(panels=2), "Observing", None),
        (READY, "Trend", None),
        ({**READY, "declining_families": 2, "depth_growth_pct": 10}, "Inflection Watch", "loosening"),
        ({**READY, "rising_families": 2, "depth_growth_pct": -10}, "Inflection Watch", "intensifying"),
        ({**READY, "rising_families": 1, "depth_growth_pct": -40}, "Trend", None),
        ({**READY, "rising_families": 2, "depth_growth_pct": None}, "Trend", None),
        ({**READY, "rising_families": 2, "depth_growth_pct": -10, "depth_valid_dates": 19}, "Trend", None),
        ({**READY, "intensifying_confirmed": 2}, "Confirmed", "intensifying"),
        ({**READY, "intensifying_confirmed": 2, "loosening_confirmed": 2}, "Confirmed", "loosening"),
    ],
)
def test_supply(spark, values, state, direction):
    r = one(P.supply_clock(_row(spark, P.SUPPLY_METRICS, **values)))
    assert (r.state, r.direction) == (state, direction)
    assert (r.blockers == ["insufficient_panel_history"]) == (state == "Observing")


def test_supply_from_panels(spark):
    def line(series, first, last, n=120):
        return [(series, x, first + (last - first) * i / (n - 1)) for i, x in enumerate(days("2026-01-01", n))]

    rising = spark.createDataFrame(line("H200", 2.0, 8.0) + line("B200", 4.0, 16.0) + line("H100", 2.0, 2.0), "series string, date date, v double")
    panels = S.panel_summary(rising, ["series"], "date", "v").withColumn("family", F.col("series"))
    depth = spark.createDataFrame([(x, 100) for x in days("2026-01-01", 30)], "date date, offers int")
    metrics = P.supply_metrics(panels, depth, "date", "offers")
    r = one(P.supply_clock(metrics))
    assert (r.state, r.direction, r.metrics["intensifying_confirmed"]) == ("Confirmed", "intensifying", 2.0)
    conditions = {(x.direction, x.condition): x for x in P.supply_watch_conditions(metrics, panels).collect()}
    assert conditions[("intensifying", "two_families_up_10pct_30d")].evidence == ["B200", "H200"]
    assert len(conditions) == 6 and not conditions[("loosening", "depth_up_10pct")].met
    one_family = panels.where("series <> 'B200'")
    assert one(P.supply_clock(P.supply_metrics(one_family, depth, "date", "offers"))).state == "Trend"


@pytest.mark.parametrize(
    "n, growth, state, loose, tight, blockers",
    [
        (0, None, "Unobservable", False, False, ["no_orderbook_history"]),
        (9, 50, "Observing", False, False, ["insufficient_orderbook_history_9.0_of_10"]),
        (10, 50, "Trend", False, False, []),
        (20, 25, "Trend", True, False, []),
        (20, -25, "Trend", False, True, []),
    ],
)
def test_capacity(spark, n, growth, state, loose, tight, blockers):
    r = one(P.capacity_clock(_row(spark, P.CAPACITY_METRICS, depth_valid_dates=n, depth_growth_pct=growth)))
    assert (r.state, r.loosening_watch, r.intensifying_watch, r.blockers) == (state, loose, tight, blockers)


def test_capacity_on_no_rows(spark):
    empty = spark.createDataFrame([], "date date, offers int, gpus int, provider string")
    metrics = P.capacity_metrics(empty, "date", "offers", empty, "gpus", empty, "provider")
    assert one(P.capacity_clock(metrics)).state == "Unobservable"


@pytest.mark.parametrize("n, state, count", [(0, "Unobservable", 2), (51, "Observing", 2), (52, "Trend", 1)])
def test_demand(spark, n, state, count):
    r = one(P.demand_clock(_row(spark, P.DEMAND_METRICS, complete_periods=n)))
    assert (r.state, len(r.blockers)) == (state, count)
    assert r.blockers[-1] == "proxy_ceiling_requires_official_usage_for_inflection"


def test_demand_price_change_uses_the_eighth_row_back(spark):
    weeks = spark.createDataFrame([(x, 100.0, float(i)) for i, x in enumerate(days("2026-01-05", 9, 7), 1)], "t date, tokens double, price double")
    ledger = spark.createDataFrame([("m", d("2026-03-01"), 0, 10.0), ("m", d("2026-03-01"), 1, 8.0)], "m string, t date, seq long, v double")
    labs = spark.createDataFrame([("a", d("2026-01-01"))], "lab string, t date")
    r = one(P.demand_metrics(weeks, "t", "tokens", "price", ledger, ["m"], "t", "seq", "v", labs, "lab", "t", F.lit("2026-03-20").cast("date")))
    assert (r.complete_periods, r.price_change_8w_pct, r.recent_price_cut_models, r.labs_covered) == (9, 350.0, 1, 1)
    short = one(P.demand_metrics(weeks.limit(7), "t", "tokens", "price", ledger, ["m"], "t", "seq", "v", labs, "lab", "t", F.lit("2026-03-20").cast("date")))
    assert short.price_change_8w_pct is None


def _actuals(company, quarters):
    return [(company, "capex actual", f"FY{fy} Q{q}", 1.0, i) for i, (fy, q) in enumerate(quarters)]


def _commitment(spark, data, bands=()):
    df = spark.createDataFrame(data, "company string, metric string, period string, value double, seq int")
    band_df = spark.createDataFrame(list(bands), "date date, low double, high double")
    return one(P.commitment_clock(P.commitment_metrics(df, band_df)))


def test_commitment_branches(spark):
    run = [(2025, 4), (2026, 1), (2026, 2)]
    trend = sum([_actuals(c, run) for c in "abc"], [])
    r = _commitment(spark, trend, [(d("2026-01-01"), 2.0, 4.0), (d("2026-06-01"), 3.0, 5.0)])
    assert (r.state, r.blockers, r.metrics["companies_with_run"], r.metrics["latest_midpoint"]) == ("Trend", [], 3.0, 4.0)
    gap = _actuals("a", [(2026, 1), (2026, 3), (2026, 4)]) + _actuals("b", run)
    r = _commitment(spark, gap)
    assert r.state == "Observing"
    assert r.blockers == ["companies_with_3_consecutive_quarters_1_of_3", "longest_true_quarter_run_3_(b)_needs_3"]
    guidance = lambda c, low, prev: [(c, "fy2026 capex guidance low", "FY2026", low, 0), (c, "fy2026 capex guidance previous low", "FY2026", prev, 1)]
    up = trend + guidance("a", 5.0, 4.0) + guidance("b", 5.0, 4.0)
    assert (_commitment(spark, up).state, _commitment(spark, up).direction) == ("Inflection Watch", "intensifying")
    both = up + guidance("c", 3.0, 4.0) + guidance("d", 3.0, 4.0)
    assert _commitment(spark, both).direction == "loosening"
    only = _commitment(spark, guidance("a", 5.0, 4.0))
    assert (only.state, only.blockers) == ("Unobservable", ["no_capex_actuals"])


@pytest.mark.parametrize(
    "values, state, blockers",
    [
        (dict(), "Unobservable", ["no_exact_configuration_series"]),
        (dict(exact_series=5), "Observing", ["no_fixed_matched_panel"]),
        (dict(exact_series=5, panel_count=2), "Observing", ["insufficient_panel_history"]),
        (dict(exact_series=5, panel_count=2, chart_ready_panels=2, confirmed_90d_breadth=2), "Confirmed", []),
        (
            dict(exact_series=5, panel_count=2, chart_ready_panels=2, depth_growth_pct=None), "Trend",
            ["insufficient_30d_duration", "insufficient_market_breadth", "depth_not_confirming"],
        ),
        (
            dict(exact_series=5, panel_count=2, chart_ready_panels=2, inflection_ready_panels=2, decline_30d_breadth=2, depth_valid_dates=20, depth_growth_pct=10),
            "Inflection Watch", [],
        ),
    ],
)
def test_one_way_supply(spark, values, state, blockers):
    r = one(P.one_way_supply_clock(_row(spark, P.ONE_WAY_SUPPLY_METRICS, **values)))
    assert (r.state, r.blockers) == (state, blockers)


@pytest.mark.parametrize(
    "n, growth, breadth, state",
    [(0, None, 0, "Unobservable"), (9, 90, 3, "Observing"), (19, 90, 3, "Trend"), (60, 0, 2, "Confirmed"), (59, 25, 2, "Inflection Watch"), (59, 25, 1, "Trend"), (59, None, 2, "Trend")],
)
def test_one_way_capacity(spark, n, growth, breadth, state):
    names = ["depth_valid_dates", "depth_growth_pct", "expanding_breadth"]
    r = one(P.one_way_capacity_clock(_row(spark, names, depth_valid_dates=n, depth_growth_pct=growth, expanding_breadth=breadth)))
    assert r.state == state
    assert (r.blockers == []) == (state in ("Confirmed", "Inflection Watch"))


@pytest.mark.parametrize(
    "values, state, blockers",
    [
        (dict(), "Unobservable", ["no_usage_or_price_change_series"]),
        (dict(usage_series=3), "Observing", ["insufficient_usage_history"]),
        (dict(usage_series=3, chart_ready_series=1, proxy_series=1), "Trend", ["proxy_not_inflection_eligible"]),
        (dict(usage_series=3, chart_ready_series=1), "Trend", ["usage_price_bridge_unconfirmed"]),
        (dict(usage_series=3, chart_ready_series=1, official_inflection_series=1, negative_price_changes=3), "Inflection Watch", []),
        (dict(usage_series=3, chart_ready_series=1, official_inflection_series=2, negative_price_changes=3, positive_commercial_changes=2), "Confirmed", []),
    ],
)
def test_one_way_demand(spark, values, state, blockers):
    names = ["usage_series", "chart_ready_series", "proxy_series", "official_inflection_series", "negative_price_changes", "positive_commercial_changes"]
    r = one(P.one_way_demand_clock(_row(spark, names, **values)))
    assert (r.state, r.blockers) == (state, blockers)


@pytest.mark.parametrize(
    "values, state",
    [
        (dict(), "Unobservable"),
        (dict(event_count=3), "Observing"),
        (dict(event_count=3, trend_companies=3), "Trend"),
        (dict(event_count=3, trend_companies=3, negative_guidance=2), "Inflection Watch"),
        (dict(event_count=3, negative_guidance=2, declining=2), "Confirmed"),
    ],
)
def test_one_way_commitment(spark, values, state):
    names = ["event_count", "sequential_companies", "trend_companies", "declining", "negative_guidance", "positive_guidance"]
    assert one(P.one_way_commitment_clock(_row(spark, names, **values))).state == state


def test_transitions(spark):
    schema = "clock_id string, state string"
    prev = spark.createDataFrame([("a", "Trend"), ("b", "Confirmed"), ("c", "Observing")], schema)
    cur = spark.createDataFrame([("a", "Confirmed"), ("b", "Observing"), ("c", "Observing"), ("n", "Trend")], schema)
    assert rows(P.transitions(prev, cur), "clock_id", "change_type") == [("a", "upgrade"), ("b", "downgrade"), ("n", "initial_state")]
    assert P.transitions(cur, cur).count() == 0


def test_history(spark):
    df = spark.createDataFrame([("a", d("2026-01-01"), "Trend"), ("a", d("2026-01-02"), "Trend"), ("a", d("2026-01-03"), "Observing")], "clock_id string, as_of date, state string")
    assert rows(P.state_history(df), "as_of", "change_type") == [(d("2026-01-01"), "initial_state"), (d("2026-01-03"), "downgrade")]


@pytest.mark.parametrize(
    "state, direction, commit, ups, downs, expected",
    [
        ("Confirmed", "intensifying", None, 0, 1, ("intensifying", "guidance_mixed")),
        ("Confirmed", "intensifying", "intensifying", 2, 0, ("intensifying", "guidance_partly_raised")),
        ("Confirmed", "intensifying", None, 2, 0, ("intensifying", "guidance_not_confirming")),
        ("Confirmed", "loosening", None, 0, 0, ("loosening", None)),
        ("Inflection Watch", "loosening", None, 0, 0, ("watch", None)),
        ("Trend", None, None, 0, 0, ("neutral", None)),
    ],
)
def test_stance(spark, state, direction, commit, ups, downs, expected):
    clocks = spark.createDataFrame(
        [("supply_price", state, direction), ("commitment_monetization", "Trend", commit)], "clock_id string, state string, direction string"
    )
    assert tuple(one(P.stance(clocks, F.lit(ups), F.lit(downs)))) == expected


def test_a_point_with_one_price_is_no_base_of_a_cut(spark):
    ledger = [("m", "2026-01-01", 1, 9.0, None), ("m", "2026-01-02", 2, 5.0, 1.0), ("k", "2026-01-01", 3, 9.0, 1.0), ("k", "2026-01-02", 4, 5.0, 1.0)]
    points = spark.createDataFrame([(m, d(t), s, v, o) for m, t, s, v, o in ledger], "model string, date date, seq long, value double, output double")
    weeks = spark.createDataFrame([(d("2026-01-01"), 5.0, 1.0)], "date date, tokens double, price double")
    labs = spark.createDataFrame([("x", d("2026-01-01"))], "lab string, date date")
    cuts = lambda beside: one(
        P.demand_metrics(weeks, "date", "tokens", "price", points, ["model"], "date", "seq", "value", labs, "lab", "date", F.lit(d("2026-01-05")), beside)
    ).recent_price_cut_models
    assert (cuts(None), cuts("output")) == (2, 1)
