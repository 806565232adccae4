"""Evidence-state jobs: each clock is one row of metrics judged by ordered rules.

States are ordered Unobservable < Observing < Trend < Inflection Watch < Confirmed and the first
matching rule decides. Thresholds are parameters; dates are passed in, never read from a clock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.filings import guidance_revision_low_only
from tidemark.operators.joins import current_with_previous
from tidemark.operators.series import (
    complete_period_count,
    decline_vs_prior,
    half_window_growth,
    longest_consecutive_run,
    recent_cuts,
)
from tidemark.functions.scalars import fiscal_quarter


def beside(*frames: DataFrame) -> DataFrame:
    """One row from several one-row frames with different columns."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


def decide(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """Value of the first rule that holds; a null condition does not hold."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    acc = None
    for condition, value in rules:
        acc = F.when(condition, lift(value)) if acc is None else acc.when(condition, lift(value))
    return acc.otherwise(lift(otherwise))


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def distinct_where(condition: Column, c: str) -> Column:
    return F.count_distinct(F.when(condition, F.col(c)))


def labels_where(condition: Column, c: str) -> Column:
    """Sorted distinct labels; for columns drawn from a fixed rule set such as product families."""
    return F.array_sort(F.collect_set(F.when(condition, F.col(c))))


def blockers(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def as_clock(df: DataFrame, clock_id: str, metrics: Sequence[str], **columns: Column) -> DataFrame:
    """The common one-row clock shape, so clocks can be unioned."""
    none = F.lit(None).cast("string")
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    return df.select(
        F.lit(clock_id).alias("clock_id"),
        columns["state"].alias("state"),
        columns.get("direction", none).alias("direction"),
        columns.get("loosening_watch", F.lit(False)).alias("loosening_watch"),
        columns.get("intensifying_watch", F.lit(False)).alias("intensifying_watch"),
        columns.get("blockers", F.array().cast("array<string>")).alias("blockers"),
        F.create_map(*pairs).alias("metrics"),
    )


def depth_growth(daily: DataFrame, t: str, offers: str) -> DataFrame:
    """Valid days, latest total and growth between the halves of the last 60 days."""
    base = daily.agg(F.count(F.lit(1)).alias("depth_valid_dates"), F.max_by(offers, t).alias("depth_latest_total"))
    growth = half_window_growth(daily, t, offers).select(F.col("growth_pct").alias("depth_growth_pct"))
    return beside(base, growth)


def supply_metrics(panels: DataFrame, daily: DataFrame, t: str, offers: str) -> DataFrame:
    """Breadth counts over distinct families beside the depth figures.

    ``panels`` is a panel summary with a ``family`` column.
    """
    watch = F.col("inflection_eligible")
    ninety = F.col("confirmed_90d_eligible")
    c30, c90 = F.col("change_30d_pct"), F.col("change_90d_pct")
    breadth = panels.agg(
        F.count(F.lit(1)).alias("panels"),
        F.count_if("chart_ready").alias("chart_ready_panels"),
        distinct_where(watch & (c30 <= -10), "family").alias("declining_families"),
        distinct_where(watch & (c30 >= 10), "family").alias("rising_families"),
        distinct_where(ninety & (c90 <= -15), "family").alias("loosening_confirmed"),
        distinct_where(ninety & (c90 >= 15), "family").alias("intensifying_confirmed"),
    )
    return beside(breadth, depth_growth(daily, t, offers))


SUPPLY_METRICS = [
    "panels", "chart_ready_panels", "declining_families", "rising_families",
    "loosening_confirmed", "intensifying_confirmed",
    "depth_valid_dates", "depth_latest_total", "depth_growth_pct",
]


def _supply_watch() -> tuple[Column, Column]:
    dated = F.col("depth_valid_dates") >= 20
    loosening = holds((F.col("declining_families") >= 2) & (F.col("depth_growth_pct") >= 10) & dated)
    intensifying = holds((F.col("rising_families") >= 2) & (F.col("depth_growth_pct") <= -10) & dated)
    return loosening, intensifying


def supply_clock(metrics: DataFrame) -> DataFrame:
    """Two-sided supply price state; confirmed loosening outranks confirmed intensifying."""
    loosening, intensifying = _supply_watch()
    no_panels = F.coalesce(F.col("panels"), F.lit(0)) == 0
    no_history = F.coalesce(F.col("chart_ready_panels"), F.lit(0)) == 0
    loose90 = F.col("loosening_confirmed") >= 2
    tight90 = F.col("intensifying_confirmed") >= 2
    state = decide(
        [
            (no_panels, "Unobservable"),
            (no_history, "Observing"),
            (loose90 | tight90, "Confirmed"),
            (loosening | intensifying, "Inflection Watch"),
        ],
        "Trend",
    )
    direction = decide(
        [
            (no_panels | no_history, F.lit(None).cast("string")),
            (loose90, "loosening"),
            (tight90, "intensifying"),
            (loosening, "loosening"),
            (intensifying, "intensifying"),
        ],
        F.lit(None).cast("string"),
    )
    return as_clock(
        metrics,
        "supply_price",
        SUPPLY_METRICS,
        state=state,
        direction=direction,
        loosening_watch=loosening,
        intensifying_watch=intensifying,
        blockers=blockers(F.when(~no_panels & no_history, "insufficient_panel_history")),
    )


def supply_watch_conditions(metrics: DataFrame, panels: DataFrame) -> DataFrame:
    """One row per (clock, direction, condition) with whether it is met and its evidence."""
    watch, c30 = F.col("inflection_eligible"), F.col("change_30d_pct")
    names = panels.agg(
        labels_where(watch & (c30 <= -10), "family").alias("_falling"),
        labels_where(watch & (c30 >= 10), "family").alias("_rising"),
    )
    none = F.array().cast("array<string>")

    def row(direction: str, condition: str, met: Column, evidence: Column = none) -> Column:
        return F.struct(
            F.lit("supply_price").alias("clock_id"),
            F.lit(direction).alias("direction"),
            F.lit(condition).alias("condition"),
            holds(met).alias("met"),
            evidence.alias("evidence"),
        )

    growth, dated = F.col("depth_growth_pct"), F.col("depth_valid_dates") >= 20
    rows = F.array(
        row("loosening", "two_families_down_10pct_30d", F.col("declining_families") >= 2, F.col("_falling")),
        row("loosening", "depth_up_10pct", growth >= 10),
        row("loosening", "depth_20_valid_days", dated),
        row("intensifying", "two_families_up_10pct_30d", F.col("rising_families") >= 2, F.col("_rising")),
        row("intensifying", "depth_down_10pct", growth <= -10),
        row("intensifying", "depth_20_valid_days", dated),
    )
    return beside(metrics, names).select(F.inline(rows))


def capacity_metrics(daily: DataFrame, t: str, offers: str, gpus: DataFrame, gpu_value: str, providers: DataFrame, provider: str) -> DataFrame:
    rows = providers.agg(
        F.count(F.lit(1)).alias("provider_rows"), F.count_distinct(F.col(provider)).alias("providers_covered")
    )
    latest = gpus.agg(F.max_by(gpu_value, t).alias("latest_gpu_capacity"))
    return beside(depth_growth(daily, t, offers), latest, rows)


CAPACITY_METRICS = [
    "depth_valid_dates", "depth_latest_total", "depth_growth_pct",
    "latest_gpu_capacity", "provider_rows", "providers_covered",
]


def capacity_clock(metrics: DataFrame) -> DataFrame:
    """Depth history decides the state; a 25% move with 20 days only raises a watch flag."""
    n, growth = F.col("depth_valid_dates"), F.col("depth_growth_pct")
    state = decide([(n == 0, "Unobservable"), (n >= 10, "Trend")], "Observing")
    short = F.concat(F.lit("insufficient_orderbook_history_"), n.cast("string"), F.lit("_of_10"))
    return as_clock(
        metrics,
        "capacity",
        CAPACITY_METRICS,
        state=state,
        loosening_watch=holds((growth >= 25) & (n >= 20)),
        intensifying_watch=holds((growth <= -25) & (n >= 20)),
        blockers=blockers(F.when(n == 0, "no_orderbook_history").when(n < 10, short)),
    )


def demand_metrics(
    weeks: DataFrame, t: str, tokens: str, price: str,
    ledger: DataFrame, ledger_keys: Sequence[str], ledger_t: str, seq: str, ledger_price: str,
    labs: DataFrame, lab: str, lab_t: str, as_of: Column, ledger_beside: str | None = None,
) -> DataFrame:
    """Complete weeks, 8-row price change, models with recent cuts and covered labs.

    ``weeks`` holds one row per week with total tokens and the weighted price. A ledger point is a base of a cut
    only if it states ``ledger_beside`` as well, where that is named.
    """
    complete = complete_period_count(weeks, t, tokens).select("complete_periods")
    last8 = weeks.orderBy(F.desc(t)).limit(8).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(t))))
    at = lambda k: F.max(F.when(F.col("_rn") == k, F.col(price)))
    change = F.when((at(8) != 0) & (at(1) != 0), (at(1) / at(8) - 1) * 100)
    price_change = last8.agg(
        change.alias("price_change_8w_pct"), F.max(F.when(F.col("_rn") == 1, F.col(tokens))).alias("latest_weekly_tokens")
    )
    cuts = recent_cuts(ledger, ledger_keys, ledger_t, seq, ledger_price, as_of, beside=ledger_beside).agg(
        F.count(F.lit(1)).alias("recent_price_cut_models")
    )
    covered = labs.agg(F.count_distinct(F.col(lab)).alias("labs_covered"))
    return beside(complete, price_change, cuts, covered)


DEMAND_METRICS = [
    "complete_periods", "latest_weekly_tokens", "price_change_8w_pct", "recent_price_cut_models", "labs_covered",
]


def demand_clock(metrics: DataFrame, min_weeks: int = 52) -> DataFrame:
    """Usage is a public proxy, so Trend is the ceiling."""
    n = F.coalesce(F.col("complete_periods"), F.lit(0))
    state = decide([(n == 0, "Unobservable"), (n >= min_weeks, "Trend")], "Observing")
    short = F.concat(F.lit("incomplete_weeks_"), n.cast("string"), F.lit(f"_of_{min_weeks}"))
    return as_clock(
        metrics,
        "demand_unit_economics",
        DEMAND_METRICS,
        state=state,
        blockers=blockers(
            F.when(n == 0, "no_usage_series").when(n < min_weeks, short),
            F.lit("proxy_ceiling_requires_official_usage_for_inflection"),
        ),
    )


def quarter_runs(rows: DataFrame) -> DataFrame:
    """Longest run of consecutive fiscal quarters per company from labelled single-quarter actuals."""
    label = fiscal_quarter("period")
    actual = rows.where((F.col("metric") == "capex actual") & (F.coalesce("company", F.lit("")) != ""))
    placed = actual.withColumn("_q", label).where("_q IS NOT NULL")
    return longest_consecutive_run(placed, ["company"], F.col("_q.fy") * 4 + F.col("_q.q"))


def contract_direction(bands: DataFrame, t: str, low: str, high: str) -> DataFrame:
    """Direction of band midpoints from the first to the last dated survey."""
    mid = ((F.col(low) + F.col(high)) / 2).alias("_mid")
    known = bands.where(F.col(t).isNotNull() & (F.col(low) > 0) & (F.col(high) > 0)).select(t, mid)
    ends = known.agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_mid", F.struct(F.col(t), F.col("_mid"))).alias("first_midpoint"),
        F.max_by("_mid", F.struct(F.col(t), F.col("_mid"))).alias("latest_midpoint"),
    )
    delta = F.col("latest_midpoint") - F.col("first_midpoint")
    label = F.when(delta > 0, "rising").when(delta < 0, "falling").otherwise("flat")
    return ends.select(
        "first_midpoint", "latest_midpoint", F.when(F.col("_n") >= 2, label).alias("contract_direction")
    )


def commitment_metrics(rows: DataFrame, bands: DataFrame, t: str = "date", low: str = "low", high: str = "high") -> DataFrame:
    runs = quarter_runs(rows)
    run_counts = runs.agg(
        F.count(F.lit(1)).alias("companies_covered"),
        F.count_if(F.col("longest_run") >= 3).alias("companies_with_run"),
        F.coalesce(F.max("longest_run"), F.lit(0)).alias("max_run"),
        F.min_by("company", F.struct(-F.col("longest_run"), F.col("company"))).alias("longest_company"),
    )
    moves = guidance_revision_low_only(rows).agg(
        F.count_if(F.col("move") == "up").alias("guidance_up"), F.count_if(F.col("move") == "down").alias("guidance_down")
    )
    return beside(run_counts, moves, contract_direction(bands, t, low, high))


COMMITMENT_METRICS = [
    "companies_covered", "companies_with_run", "max_run", "guidance_up", "guidance_down",
    "first_midpoint", "latest_midpoint",
]


def commitment_clock(metrics: DataFrame) -> DataFrame:
    """Quarter runs give the base state; two guidance moves override it, loosening first."""
    loosening = holds(F.col("guidance_down") >= 2)
    intensifying = holds(F.col("guidance_up") >= 2)
    none, some = F.col("companies_covered") == 0, F.col("companies_with_run")
    state = decide(
        [
            (loosening | intensifying, "Inflection Watch"),
            (none, "Unobservable"),
            (some >= 3, "Trend"),
        ],
        "Observing",
    )
    direction = decide(
        [(loosening, "loosening"), (intensifying, "intensifying")], F.lit(None).cast("string")
    )
    short = F.concat(F.lit("companies_with_3_consecutive_quarters_"), some.cast("string"), F.lit("_of_3"))
    longest = F.concat(
        F.lit("longest_true_quarter_run_"), F.col("max_run").cast("string"), F.lit("_("), F.col("longest_company"), F.lit(")_needs_3")
    )
    return as_clock(
        metrics,
        "commitment_monetization",
        COMMITMENT_METRICS,
        state=state,
        direction=direction,
        loosening_watch=loosening,
        intensifying_watch=intensifying,
        blockers=blockers(
            F.when(none, "no_capex_actuals").when(some < 3, short), F.when(~none & (some < 3), longest)
        ),
    )


def one_way_depth(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """First-to-last growth over all history and the number of entities that expanded by a quarter."""
    daily = df.groupBy(t).agg(F.sum(value).alias("_offers"))
    ends = daily.agg(
        F.count(F.lit(1)).alias("depth_valid_dates"),
        F.min_by("_offers", F.when(F.col("_offers").isNotNull(), F.col(t))).alias("depth_first_offers"),
        F.max_by("_offers", F.when(F.col("_offers").isNotNull(), F.col(t))).alias("depth_last_offers"),
    )
    growth = F.when(
        (F.col("depth_valid_dates") >= 20) & (F.col("depth_first_offers") != 0),
        (F.col("depth_last_offers") / F.col("depth_first_offers") - 1) * 100,
    )
    by_entity = (
        df.groupBy(entity, t)
        .agg(F.sum(value).alias("_offers"))
        .groupBy(entity)
        .agg(
            F.count(F.lit(1)).alias("_days"),
            F.min_by("_offers", t).alias("_first"),
            F.max_by("_offers", t).alias("_last"),
        )
    )
    grew = (F.col("_days") >= 20) & (F.col("_first") > 0) & ((F.try_divide(F.col("_last"), F.col("_first")) - 1) * 100 >= 25)
    breadth = by_entity.agg(F.count_if(grew).alias("expanding_breadth"))
    return beside(ends.withColumn("depth_growth_pct", growth), breadth)


def one_way_supply_metrics(panel_points: DataFrame, exact_series: DataFrame, depth: DataFrame) -> DataFrame:
    """``panel_points(panel_id, date, change_30d_pct, change_90d_pct, eligible_for_*)`` beside depth."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    latest = panel_points.groupBy("panel_id").agg(
        last("change_30d_pct").alias("_c30"),
        last("change_90d_pct").alias("_c90"),
        F.bool_or("eligible_for_90d").alias("_e90"),
        F.bool_or("eligible_for_chart").alias("_chart"),
        F.bool_or("eligible_for_inflection").alias("_infl"),
    )
    counts = latest.agg(
        F.count(F.lit(1)).alias("panel_count"),
        F.count_if("_chart").alias("chart_ready_panels"),
        F.count_if("_infl").alias("inflection_ready_panels"),
        F.count_if(F.col("_c30") <= -10).alias("decline_30d_breadth"),
        F.count_if(F.col("_e90") & (F.col("_c90") <= -15)).alias("confirmed_90d_breadth"),
    )
    exact = exact_series.agg(F.count(F.lit(1)).alias("exact_series"))
    return beside(counts, exact, depth)


ONE_WAY_SUPPLY_METRICS = [
    "exact_series", "panel_count", "chart_ready_panels", "inflection_ready_panels",
    "decline_30d_breadth", "confirmed_90d_breadth", "depth_valid_dates", "depth_growth_pct",
]


def one_way_supply_clock(metrics: DataFrame) -> DataFrame:
    """Decline-only supply state with a named blocker for duration, breadth and depth."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    missing = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("inflection_ready_panels"), F.lit(0)) < 2, "insufficient_30d_duration"),
            F.when(F.coalesce(F.col("decline_30d_breadth"), F.lit(0)) < 2, "insufficient_market_breadth"),
            F.when(
                (F.coalesce(F.col("depth_valid_dates"), F.lit(0)) < 20)
                | F.col("depth_growth_pct").isNull()
                | (F.col("depth_growth_pct") < 10),
                "depth_not_confirming",
            ),
        )
    )
    confirmed = F.col("confirmed_90d_breadth") >= 2
    state = decide(
        [
            (zero("exact_series"), "Unobservable"),
            (zero("panel_count") | zero("chart_ready_panels"), "Observing"),
            (confirmed, "Confirmed"),
            (F.size(missing) == 0, "Inflection Watch"),
        ],
        "Trend",
    )
    why = decide(
        [
            (zero("exact_series"), F.array(F.lit("no_exact_configuration_series"))),
            (zero("panel_count"), F.array(F.lit("no_fixed_matched_panel"))),
            (zero("chart_ready_panels"), F.array(F.lit("insufficient_panel_history"))),
            (confirmed, F.array().cast("array<string>")),
        ],
        missing,
    )
    return as_clock(metrics, "supply_price", ONE_WAY_SUPPLY_METRICS, state=state, blockers=why)


def one_way_capacity_clock(depth: DataFrame) -> DataFrame:
    """10/20/60-day ladder; the 60-day breadth test precedes the growth test."""
    n, wide = F.col("depth_valid_dates"), F.col("expanding_breadth") >= 2
    confirmed = (n >= 60) & wide
    watch = holds((F.col("depth_growth_pct") >= 25) & wide)
    state = decide(
        [
            (n == 0, "Unobservable"),
            (n < 10, "Observing"),
            (n < 20, "Trend"),
            (confirmed, "Confirmed"),
            (watch, "Inflection Watch"),
        ],
        "Trend",
    )
    why = (
        F.when(n == 0, "no_capacity_history")
        .when(n < 10, "insufficient_capacity_history")
        .when(n < 20, "insufficient_30d_duration")
        .when(~confirmed & ~watch, "capacity_breadth_not_expanding")
    )
    names = ["depth_valid_dates", "depth_growth_pct", "expanding_breadth"]
    return as_clock(depth, "capacity_utilization", names, state=state, blockers=blockers(why))


def one_way_demand_metrics(quality: DataFrame, events: DataFrame) -> DataFrame:
    """``quality(series_id, evidence_class, eligible_*)`` and ``events(track, event_type, change_pct)``."""
    proxy = F.col("evidence_class") == "public_proxy"
    series = quality.agg(
        F.count(F.lit(1)).alias("usage_series"),
        F.count_if("eligible_for_chart").alias("chart_ready_series"),
        F.count_if(F.col("eligible_for_chart") & proxy).alias("proxy_series"),
        F.count_if(F.col("eligible_for_inflection") & ~proxy).alias("official_inflection_series"),
    )
    cut = (F.col("track") == "token_price") & (F.col("event_type") == "price_change") & (F.col("change_pct") < 0)
    upgrade = (
        (F.col("track") == "app_commercialization")
        & (F.col("event_type") == "value_change")
        & (F.col("change_pct") > 0)
    )
    changes = events.agg(
        F.count_if(cut).alias("negative_price_changes"), F.count_if(upgrade).alias("positive_commercial_changes")
    )
    return beside(series, changes)


def one_way_demand_clock(metrics: DataFrame) -> DataFrame:
    cuts, official = F.col("negative_price_changes"), F.col("official_inflection_series")
    unseen = (F.col("usage_series") == 0) & (cuts == 0)
    short = F.col("chart_ready_series") == 0
    confirmed = (official >= 2) & (cuts >= 3) & (F.col("positive_commercial_changes") >= 2)
    watch = (official > 0) & (cuts >= 3)
    state = decide(
        [
            (unseen, "Unobservable"),
            (short, "Observing"),
            (confirmed, "Confirmed"),
            (watch, "Inflection Watch"),
        ],
        "Trend",
    )
    why = (
        F.when(unseen, "no_usage_or_price_change_series")
        .when(short, "insufficient_usage_history")
        .when(~confirmed & ~watch & (F.col("proxy_series") > 0), "proxy_not_inflection_eligible")
        .when(~confirmed & ~watch, "usage_price_bridge_unconfirmed")
    )
    names = [
        "usage_series", "chart_ready_series", "proxy_series", "official_inflection_series",
        "negative_price_changes", "positive_commercial_changes",
    ]
    return as_clock(metrics, "demand_unit_economics", names, state=state, blockers=blockers(why))


def one_way_commitment_metrics(actuals: DataFrame, guidance: DataFrame) -> DataFrame:
    """``actuals(entity, series_id, date, value)`` and ``guidance(entity, date, metric, value)``."""
    periods = actuals.groupBy("series_id", "entity").agg(F.count_distinct("date").alias("_n"))
    companies = periods.agg(
        distinct_where(F.col("_n") >= 2, "entity").alias("sequential_companies"),
        distinct_where(F.col("_n") >= 3, "entity").alias("trend_companies"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("event_count"),
    )
    declining = decline_vs_prior(actuals, ["series_id"], "date", "value", "entity")
    pairs = current_with_previous(guidance, "entity", "date", "metric", "value")
    moves = pairs.agg(
        distinct_where(F.col("current_value") < F.col("previous_value"), "entity").alias("negative_guidance"),
        distinct_where(F.col("current_value") > F.col("previous_value"), "entity").alias("positive_guidance"),
    )
    return beside(companies, declining, moves)


def one_way_commitment_clock(metrics: DataFrame) -> DataFrame:
    none = F.col("event_count") == 0
    short = (F.col("declining") < 2) & (F.col("negative_guidance") < 2) & (F.col("trend_companies") < 3)
    state = decide(
        [
            (none, "Unobservable"),
            (F.col("declining") >= 2, "Confirmed"),
            (F.col("negative_guidance") >= 2, "Inflection Watch"),
            (F.col("trend_companies") >= 3, "Trend"),
        ],
        "Observing",
    )
    why = F.when(none, "no_official_commitment_events").when(short, "insufficient_sequential_quarters")
    names = [
        "event_count", "sequential_companies", "trend_companies", "declining", "negative_guidance", "positive_guidance",
    ]
    return as_clock(metrics, "commitment_monetization", names, state=state, blockers=blockers(why))


def state_rank(c: str) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in config.STATES]), F.col(c))


def transitions(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Clocks whose state changed: initial_state, upgrade or downgrade; unchanged ones are left out."""
    old = prev.select("clock_id", F.col("state").alias("from_state"))
    joined = cur.select("clock_id", F.col("state").alias("to_state")).join(old, "clock_id", "left")
    kind = (
        F.when(F.col("from_state").isNull(), "initial_state")
        .when(state_rank("to_state") > state_rank("from_state"), "upgrade")
        .otherwise("downgrade")
    )
    return joined.where(~F.col("from_state").eqNullSafe(F.col("to_state"))).select(
        "clock_id", "from_state", "to_state", kind.alias("change_type")
    )


def state_history(history: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Every state change across recorded days; a clock has one row per day."""
    before = F.lag("state").over(Window.partitionBy("clock_id").orderBy(as_of))
    moved = history.select("clock_id", as_of, F.col("state").alias("to_state"), before.alias("from_state"))
    kind = (
        F.when(F.col("from_state").isNull(), "initial_state")
        .when(state_rank("to_state") > state_rank("from_state"), "upgrade")
        .otherwise("downgrade")
    )
    return moved.where(~F.col("from_state").eqNullSafe(F.col("to_state"))).select(
        "clock_id", as_of, "from_state", "to_state", kind.alias("change_type")
    )


def stance(clocks: DataFrame, guidance_up: Column, guidance_down: Column) -> DataFrame:
    """Overall level from the supply clock, qualified by how guidance moved."""
    pick = lambda clock, c: F.max(F.when(F.col("clock_id") == clock, F.col(c)))
    row = clocks.agg(
        pick("supply_price", "state").alias("_state"),
        pick("supply_price", "direction").alias("_direction"),
        pick("commitment_monetization", "direction").alias("_commit"),
    )
    tight = (F.col("_state") == "Confirmed") & (F.col("_direction") == "intensifying")
    loose = (F.col("_state") == "Confirmed") & (F.col("_direction") == "loosening")
    watch = F.col("_state") == "Inflection Watch"
    level = F.when(tight, "intensifying").when(loose, "loosening").when(watch, "watch").otherwise("neutral")
    confirmation = (
        F.when(tight & (guidance_down > 0), "guidance_mixed")
        .when(tight & (F.col("_commit") == "intensifying") & (guidance_up > 0), "guidance_partly_raised")
        .when(tight, "guidance_not_confirming")
    )
    return row.select(level.alias("level"), confirmation.alias("guidance_note"))


def evidence_rows(df: DataFrame, columns: Sequence[str], order: Sequence[Column], k: int = 8) -> DataFrame:
    """Supporting rows of a clock: a top-k report."""
    return df.select(*columns).orderBy(*order).limit(k)


def evaluate(clocks: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """All clocks of one run, stamped with its day."""
    rows = reduce(lambda a, b: a.unionByName(b), clocks.values())
    return rows.withColumn("as_of", as_of)
