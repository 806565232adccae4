"""Time-series operators. Inputs hold one row per (series, day or period), so a window over one
series is bounded by the calendar; reduce raw rows with an aggregation first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column
from tidemark.operators.ordered import finite, lag_in_order, null_safe_join, rank_in_order


def _ordered(keys: Sequence[str], t: str):
    return Window.partitionBy(*keys).orderBy(t)


def pct_change(new: ColumnLike, old: ColumnLike) -> Column:
    base = as_column(old)
    return F.when(base > 0, (as_column(new) / base - 1) * 100)


def _window_change(t: str, value: str, latest: str, days: int, tolerance: int, pick: str) -> Column:
    """Aggregate expression: latest value against a base inside the tolerance window."""
    low = F.date_sub(F.col(latest), days + tolerance)
    high = F.date_sub(F.col(latest), max(1, days - tolerance))
    inside = F.col(t).between(low, high)
    if pick == "recent":
        base = F.max_by(value, F.when(inside, F.col(t)))
    elif pick == "nearest":
        target = F.date_sub(F.col(latest), days)
        distance = F.struct(F.abs(F.date_diff(F.col(t), target)), F.date_diff(target, F.col(t)))
        base = F.min_by(value, F.when(inside, distance))
    else:
        raise ValueError(f"unknown pick {pick}")
    current = F.max_by(value, F.when(F.col(t) == F.col(latest), F.col(t)))
    return F.when(base > 0, (current / base - 1) * 100)


def change_pct_window(
    df: DataFrame, keys: Sequence[str], t: str, value: str, days: int,
    tolerance: int = 10, min_points: int = 2, pick: str = "recent", name: str = "change_pct",
) -> DataFrame:
    """Latest value against the most recent point dated ``days`` +- ``tolerance`` before it."""
    marked = df.withColumn("_latest", F.max(t).over(Window.partitionBy(*keys)))
    change = _window_change(t, value, "_latest", days, tolerance, pick)
    return marked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= min_points, change).alias(name))


def panel_summary(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Span, eligibility and 30/90-day changes of every series, in one shuffle."""
    marked = df.withColumn("_latest", F.max(t).over(Window.partitionBy(*keys)))
    n = F.count(F.lit(1))
    return marked.groupBy(*keys).agg(
        n.alias("valid_days"),
        F.min(t).alias("first_date"),
        F.max(t).alias("last_date"),
        (F.date_diff(F.max(t), F.min(t)) + 1).alias("span_days"),
        (n >= 10).alias("chart_ready"),
        (n >= 20).alias("inflection_eligible"),
        (n >= 60).alias("confirmed_90d_eligible"),
        F.when(n >= 2, _window_change(t, value, "_latest", 30, 10, "recent")).alias("change_30d_pct"),
        F.when(n >= 2, _window_change(t, value, "_latest", 90, 10, "recent")).alias("change_90d_pct"),
    )


def trailing_mean_full(
    df: DataFrame, keys: Sequence[str], t: str, values: dict[str, str], n: int = 4
) -> DataFrame:
    """Mean over exactly ``n`` rows per output column; rows before the window fills are left out."""
    w = _ordered(keys, t)
    frame = w.rowsBetween(1 - n, 0)
    out = df.withColumn("_rn", F.row_number().over(w))
    for source, name in values.items():
        out = out.withColumn(name, F.avg(source).over(frame))
    return out.where(F.col("_rn") >= n).drop("_rn")


def trailing_mean_partial(
    df: DataFrame, keys: Sequence[str], t: str, value: str, n: int = 30, name: str = "moving_average"
) -> DataFrame:
    """Mean over at most ``n`` rows (rows, not days)."""
    return df.withColumn(name, F.avg(value).over(_ordered(keys, t).rowsBetween(1 - n, 0)))


def rolling_median(
    df: DataFrame, keys: Sequence[str], t: str, value: str, n: int = 30, name: str = "rolling_median"
) -> DataFrame:
    """Median over at most the last ``n`` rows."""
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(_ordered(keys, t).rowsBetween(1 - n, 0)))


def ma_index(df: DataFrame, keys: Sequence[str], t: str, value: str, n: int = 4) -> DataFrame:
    """Full-window trailing mean, then 100 at its first value per key."""
    means = trailing_mean_full(df, keys, t, {value: "average"}, n)
    base = F.first("average").over(_ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0))
    return means.withColumn("index_value", F.try_divide(F.col("average"), base) * 100)


def lag_change_latest(df: DataFrame, keys: Sequence[str], t: str, value: str, n: int = 4) -> DataFrame:
    """Change of the latest row against the value ``n`` rows earlier; null on a missing or zero base."""
    w = _ordered(keys, t)
    back = Window.partitionBy(*keys).orderBy(F.desc(t))
    prior = F.lag(value, n).over(w)
    return (
        df.withColumn("_prior", prior)
        .withColumn("_rn", F.row_number().over(back))
        .where("_rn = 1")
        .select(*keys, F.when(F.col("_prior") != 0, (F.col(value) / F.col("_prior") - 1) * 100).alias("change_pct"))
    )


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key; the rank limit runs before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def ranks_with_residual(df: DataFrame, t: str, item: str, tokens: str, residual: str = "Others") -> DataFrame:
    """Rank of every item in its period by volume, the residual always last."""
    named = rank_in_order(df.where(F.col(item) != residual), [t], tokens, item)
    counts = df.groupBy(t).agg(F.count_if(F.col(item) != residual).alias("_named"))
    rest = df.where(F.col(item) == residual).join(counts, t)
    return named.unionByName(rest.withColumn("rank", F.col("_named") + 1).drop("_named"))


def largest_event_per_key(
    df: DataFrame, keys: Sequence[Column], t: str, change: str, min_abs: float = 5.0
) -> DataFrame:
    """The latest event of a key, the largest by magnitude on that day, above a noise floor."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*df.columns)
    best = (
        df.where(F.abs(change) >= min_abs)
        .groupBy(*named)
        .agg(F.max_by(row, F.struct(F.col(t), F.abs(change))).alias("_row"))
    )
    return best.select("_row.*")


def leader_changes(df: DataFrame, t: str, item: str, value: str, residual: str = "Others") -> DataFrame:
    """Periods whose largest item differs from the previous period's; the first counts as one."""
    leaders = (
        df.where(F.col(item) != residual)
        .groupBy(t)
        .agg(F.min_by(item, F.struct(-F.col(value), F.col(item))).alias("_leader"))
    )
    previous = F.lag("_leader").over(Window.orderBy(t))
    changed = leaders.withColumn("_new", ~F.col("_leader").eqNullSafe(previous))
    return changed.agg(
        F.count(F.lit(1)).alias("periods"), F.count_if("_new").alias("changes")
    )


def decline_vs_prior(df: DataFrame, keys: Sequence[str], t: str, value: str, entity: str) -> DataFrame:
    """Number of entities with any value below its predecessor."""
    prior = F.lag(value).over(_ordered(keys, t))
    return (
        df.withColumn("_prior", prior)
        .where(F.col(value) < F.col("_prior"))
        .agg(F.count_distinct(F.col(entity)).alias("declining"))
    )


def longest_consecutive_run(df: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    """Longest run of consecutive ordinals per key after removing repeats."""
    steps = df.select(*keys, ordinal.alias("_o")).where("_o IS NOT NULL").distinct()
    island = F.col("_o") - F.row_number().over(_ordered(keys, "_o"))
    runs = steps.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest_run"))


def latest_sequential_run(
    df: DataFrame, keys: Sequence[str], t: str, min_gap: int = 80, max_gap: int = 100
) -> DataFrame:
    """Length of the run of regular gaps counted back from the latest day."""
    days = df.select(*keys, t).distinct()
    back = Window.partitionBy(*keys).orderBy(F.desc(t))
    gap = F.date_diff(F.lag(t).over(back), F.col(t))
    broken = F.when(gap.isNull() | gap.between(min_gap, max_gap), 0).otherwise(1)
    breaks = F.sum("_broken").over(back.rowsBetween(Window.unboundedPreceding, 0))
    return (
        days.withColumn("_broken", broken)
        .withColumn("_breaks", breaks)
        .groupBy(*keys)
        .agg(F.count_if(F.col("_breaks") == 0).alias("run"))
    )


def mark_partial_first(df: DataFrame, keys: Sequence[str], t: str, value: str, ratio: float = 0.5) -> DataFrame:
    """Flags the first period when it is under ``ratio`` of the second and the second is positive."""
    w = _ordered(keys, t)
    following = F.lead(value).over(w)
    first = F.row_number().over(w) == 1
    partial = first & (following > 0) & (F.col(value) < F.lit(ratio) * following)
    return df.withColumn("is_partial", F.coalesce(partial, F.lit(False)))


def drop_partial_first(df: DataFrame, keys: Sequence[str], t: str, value: str, ratio: float = 0.5) -> DataFrame:
    return mark_partial_first(df, keys, t, value, ratio).where(~F.col("is_partial")).drop("is_partial")


def complete_period_count(df: DataFrame, t: str, value: str, ratio: float = 0.5) -> DataFrame:
    """Number of periods with a value, less a partial first one, and the dropped period if any."""
    marked = mark_partial_first(df.where(F.col(value).isNotNull()), [], t, value, ratio)
    return marked.agg(
        F.count_if(~F.col("is_partial")).alias("complete_periods"),
        F.max(F.when(F.col("is_partial"), F.col(t))).alias("dropped"),
    )


def composition_changes(df: DataFrame, keys: Sequence[str], t: str, count: str) -> DataFrame:
    """Days on which the member count differs from the previous day's, labelled ``a→b``."""
    previous = F.lag(count).over(_ordered(keys, t))
    return (
        df.withColumn("_prev", previous)
        .where(F.col(count) != F.col("_prev"))
        .select(*keys, t, F.concat(F.col("_prev").cast("string"), F.lit("→"), F.col(count).cast("string")).alias("label"))
    )


def half_window_growth(df: DataFrame, t: str, value: str, n: int = 60, min_days: int = 4) -> DataFrame:
    """Mean of the later half against the earlier half of the last ``n`` days; one row per day in."""
    recent = df.orderBy(F.desc(t)).limit(n)
    w = Window.orderBy(t)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    placed = recent.withColumn("_rn", F.row_number().over(w)).withColumn("_total", total)
    half = F.greatest(F.lit(1), F.floor(F.col("_total") / 2))
    early = F.avg(F.when(F.col("_rn") <= half, F.col(value)))
    late = F.avg(F.when(F.col("_rn") > half, F.col(value)))
    enough = F.count(F.lit(1)) >= min_days
    return placed.agg(
        F.count(F.lit(1)).alias("window_days"), F.when(enough & (early > 0), (late / early - 1) * 100).alias("growth_pct")
    )


def rebase_common_start(
    df: DataFrame, group: Sequence[str], series: str, t: str, value: str, min_series: int = 2
) -> DataFrame:
    """Each series of a group as 100 at its first value on or after the day all of them exist.

    Groups with fewer than ``min_series`` series pass unchanged; a zero base drops the series.
    """
    if not group:
        whole = df.withColumn("_all", F.lit(1))
        return rebase_common_start(whole, ["_all"], series, t, value, min_series).drop("_all")
    spans = df.groupBy(*group, series).agg(F.min(t).alias("_start"))
    common = spans.groupBy(*group).agg(
        F.max("_start").alias("common_start"), F.count(F.lit(1)).alias("_series_count")
    )
    marked = null_safe_join(df, common, group)
    after = marked.where((F.col(t) >= F.col("common_start")) | (F.col("_series_count") < min_series))
    base = F.first(value).over(_ordered([*group, series], t).rowsBetween(Window.unboundedPreceding, 0))
    rebased = after.withColumn("_base", base)
    single = F.col("_series_count") < min_series
    return rebased.where(single | (F.col("_base") != 0)).select(
        *group,
        series,
        t,
        F.when(single, F.col(value)).otherwise(F.try_divide(F.lit(100) * F.col(value), F.col("_base"))).alias("value"),
        F.when(~single, F.col("common_start")).alias("common_start"),
    )


def recent_cuts(
    df: DataFrame, keys: Sequence[str], t: str, seq: str, value: str, as_of: Column, days: int = 90, beside: str | None = None
) -> DataFrame:
    """Keys with a drop between consecutive points inside the window; older prices are not a base.

    A point counts only if ``value``, and ``beside`` if it is named, are numbers: a ledger point states both prices.
    """
    window = df.where((F.col(t) >= F.date_sub(as_of, days)) & F.col(value).isNotNull())
    if beside is not None:
        window = window.where(F.col(beside).isNotNull())
    steps = lag_in_order(window, keys, t, seq, [value], prefix="prev_")
    return steps.where(F.col(value) < F.col(f"prev_{value}")).select(*keys).distinct()


def k_back_change(df: DataFrame, keys: Sequence[str], t: str, value: str, weeks: float) -> DataFrame:
    """Last value against the value ``round(weeks * 7)`` rows earlier; null if too short or base <= 0."""
    k = max(1, int(weeks * 7 + 0.5))
    back = Window.partitionBy(*keys).orderBy(F.desc(t))
    placed = df.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= k + 1)
    last = F.max(F.when(F.col("_rn") == 1, F.col(value)))
    base = F.max(F.when(F.col("_rn") == k + 1, F.col(value)))
    return placed.groupBy(*keys).agg(F.when(base > 0, (last / base - 1) * 100).alias("change_pct"))


def segment_gaps(df: DataFrame, keys: Sequence[str], t: str, days: int = 11, name: str = "segment") -> DataFrame:
    """Segment number of each point, a new one after a gap longer than ``days``."""
    w = _ordered(keys, t)
    opens = (F.date_diff(F.col(t), F.lag(t).over(w)) > days).cast("int")
    marked = df.withColumn("_open", F.coalesce(opens, F.lit(0)))
    running = F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, running + 1).drop("_open")


def collection_gaps(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Missing calendar days between a key's first and last day, expanded from gap edges only."""
    days = df.select(*keys, t).distinct()
    previous = F.lag(t).over(_ordered(keys, t))
    edges = days.withColumn("_prev", previous).where(F.date_diff(F.col(t), F.col("_prev")) > 1)
    missing = F.explode(F.sequence(F.date_add("_prev", 1), F.date_sub(F.col(t), 1)))
    return edges.select(*keys, missing.alias("missing_date"))


def collection_coverage(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    span = F.date_diff(F.max(t), F.min(t)) + 1
    n = F.count_distinct(F.col(t))
    return df.groupBy(*keys).agg(
        n.alias("valid_days"), span.alias("span_days"), (n / span * 100).alias("coverage_pct")
    )


def change_events(
    df: DataFrame, keys: Sequence[str], t: str, seq: str, value: str
) -> DataFrame:
    """The first observation of a key and then only true value changes, with prior value and percent."""
    prev = f"_prev_{value}"
    steps = lag_in_order(df.where(F.col(value).isNotNull()), keys, t, seq, [value], prefix="_prev_")
    kept = steps.where(F.col(prev).isNull() | (F.col(value) != F.col(prev)))
    return kept.select(
        *keys,
        t,
        seq,
        F.when(F.col(prev).isNull(), "initial_observation").otherwise("value_change").alias("event_type"),
        F.col(prev).alias("prior_value"),
        F.col(value).alias("value"),
        F.when(F.col(prev) != 0, (F.col(value) / F.col(prev) - 1) * 100).alias("change_pct"),
    )


def window_floor(df: DataFrame, t: str, reference: DataFrame, reference_t: str) -> DataFrame:
    """Rows from the reference dataset's first day on; all rows if that would leave none."""
    floor = reference.agg(F.min(reference_t)).scalar()
    newest = df.agg(F.max(t)).scalar()
    return df.where((F.col(t) >= floor) | (newest < floor) | floor.isNull())


def growth_multiple(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Last over first complete period, after a partial first one is dropped."""
    kept = drop_partial_first(df, keys, t, value)
    grouped = kept.groupBy(*keys).agg(
        F.min(t).alias("base_date"), F.min_by(value, t).alias("_first"), F.max_by(value, t).alias("_last")
    )
    return grouped.select(
        *keys, "base_date", F.when(F.col("_first") > 0, F.col("_last") / F.col("_first")).alias("multiple")
    )


def first_last_change(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Change over the visible window and its direction; two points at least."""
    edges = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(value, t).alias("first_value"),
        F.max_by(value, t).alias("last_value"),
    )
    delta = F.col("last_value") - F.col("first_value")
    direction = F.when(delta > 0, "rising").when(delta < 0, "falling").otherwise("flat")
    two = F.col("points") >= 2
    return edges.select(
        *keys,
        "first_value",
        "last_value",
        F.when(two & (F.col("first_value") != 0), (F.col("last_value") / F.col("first_value") - 1) * 100).alias(
            "change_pct"
        ),
        F.when(two, direction).alias("direction"),
    )


def base100(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Every series as 100 at its first visible value; a zero first value divides by one."""
    first = F.first(value).over(_ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0))
    base = F.when(first != 0, first).otherwise(F.lit(1))
    return df.withColumn("index_value", F.col(value) / base * 100)


def top_series_history(
    df: DataFrame, item: str, t: str, value: str, n: int = 5, residual: str = "Others"
) -> DataFrame:
    """All rows of the latest period's largest items."""
    # Each item's last period and value; the largest of those in the very last period lead.
    last = df.groupBy(item).agg(F.max(t).alias("_t"), F.max_by(value, t).alias("_v"))
    newest = last.agg(F.max("_t")).scalar()
    leaders = last.where((F.col("_t") == newest) & (F.col(item) != residual)).orderBy(F.desc("_v"), item).limit(n).select(item)
    return df.join(leaders, item, "left_semi")


def indicator_accumulation(df: DataFrame, series: str, t: str, value: str, target: int = 10) -> DataFrame:
    """Collected days, progress to ``target`` and the latest day's value per series."""
    by_day = df.groupBy(t).agg(F.collect_list(F.struct(series, value)).alias("_rows"))  # one row per series and day
    last = by_day.agg(F.count(F.lit(1)).alias("days"), F.max_by("_rows", t).alias("_rows"))
    return last.select("days", F.inline("_rows")).select(
        series,
        F.col(value).alias("latest_value"),
        "days",
        F.least(F.lit(1.0), F.col("days") / F.lit(target)).alias("progress"),
    )


def gap_range(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Shortest and longest gap between consecutive distinct days, and the span."""
    days = df.select(*keys, t).distinct()
    gap = F.date_diff(F.col(t), F.lag(t).over(_ordered(keys, t)))
    return (
        days.withColumn("_gap", gap)
        .groupBy(*keys)
        .agg(
            F.min("_gap").alias("min_gap"),
            F.max("_gap").alias("max_gap"),
            F.date_diff(F.max(t), F.min(t)).alias("span_days"),
        )
    )


def panel_days(df: DataFrame, panel: str, t: str) -> DataFrame:
    """Days of each panel numbered from the latest back, which is the length of the suffix they start."""
    days = df.select(panel, t).distinct()
    return days.selectExpr(f"`{panel}`", f"`{t}`", f"row_number() OVER (PARTITION BY `{panel}` ORDER BY `{t}` DESC) AS _len")


def qualifying_spells(df: DataFrame, panel: str, member: str, t: str, coverage: float = 0.9) -> DataFrame:
    """Every quote with its day's number ``_len`` and the range of suffix lengths ``_from`` to ``_to`` it opens.

    Within the range the member covers its share. A member's count inside a suffix changes only at its own
    days, so each quote opens one range: up to the length its count can cover, or to just before its next
    earlier quote; the range is empty if ``_to < _from``. ``df`` holds one row per (panel, member, day).
    """
    days = panel_days(df, panel, t)
    totals = f"max(_len) OVER (PARTITION BY `{panel}`) AS _total"  # one row per day of the panel
    placed = df.join(days.selectExpr("*", totals), [panel, t])
    of_member = f"PARTITION BY `{panel}`, `{member}` ORDER BY _len"
    counted = placed.selectExpr(
        "*", f"row_number() OVER ({of_member}) AS _count", f"lead(_len) OVER ({of_member}) - 1 AS _before_next"
    ).withColumn("_guess", F.floor(F.col("_count") / F.lit(coverage)) + 1)
    longest = (
        f"CASE WHEN _count >= {coverage}D * _guess THEN _guess "
        f"WHEN _count >= {coverage}D * (_guess - 1) THEN _guess - 1 ELSE _guess - 2 END"
    )
    return counted.selectExpr(
        *[f"`{c}`" for c in df.columns], "_len", "_len AS _from", f"least({longest}, coalesce(_before_next, _total)) AS _to"
    )


def panel_windows(
    spells: DataFrame, panel: str, min_members: int = 3, min_days: int = 10
) -> DataFrame:
    """Longest day suffix of each panel that enough members cover, and how many do: (panel, suffix_days, _size).

    ``spells`` comes from :func:`qualifying_spells`. A running sum over interval edges gives the number
    of qualifying members at every suffix length without a day x member grid.
    """
    edges = spells.where("_to >= _from").selectExpr(
        f"`{panel}`", "inline(array(struct(CAST(_from AS BIGINT) AS _len, 1 AS _step), struct(_to + 1 AS _len, -1 AS _step)))"
    )
    steps = edges.groupBy(panel, "_len").agg(F.sum("_step").alias("_step"))
    levels = steps.selectExpr(
        f"`{panel}`",
        f"sum(_step) OVER (PARTITION BY `{panel}` ORDER BY _len) AS _members",
        f"coalesce(lead(_len) OVER (PARTITION BY `{panel}` ORDER BY _len) - 1, _len) AS _last_len",
    )
    enough = levels.where(f"_members >= {min_members} AND _last_len >= {min_days}")
    return enough.groupBy(panel).agg(F.max("_last_len").alias("suffix_days"), F.max_by("_members", "_last_len").alias("_size"))


def _chosen(
    df: DataFrame, panel: str, member: str, t: str, coverage: float, min_members: int, min_days: int
) -> DataFrame:
    """Quotes of the members of each panel's chosen suffix, with ``_len``, ``suffix_days`` and ``_size``."""
    spells = qualifying_spells(df, panel, member, t, coverage)
    joined = spells.join(panel_windows(spells, panel, min_members, min_days), panel)
    covers = f"bool_or(_to >= _from AND suffix_days BETWEEN _from AND _to) OVER (PARTITION BY `{panel}`, `{member}`) AS _covers"
    return joined.selectExpr("*", covers).where("_covers").drop("_from", "_to", "_covers")


def panel_members(
    df: DataFrame, panel: str, member: str, t: str,
    coverage: float = 0.9, min_members: int = 3, min_days: int = 10,
) -> DataFrame:
    """Members of each panel's chosen suffix, with the suffix length."""
    quotes = df.select(panel, member, t).distinct()
    return _chosen(quotes, panel, member, t, coverage, min_members, min_days).select(panel, member, "suffix_days").distinct()


def matched_panel_rows(
    df: DataFrame, panel: str, member: str, t: str, value: str,
    coverage: float = 0.9, min_members: int = 3, min_days: int = 10,
) -> DataFrame:
    """Member rows of the final window: from the first day all members quote; still ``min_days`` long.

    ``df`` holds one row per (panel, member, day); only positive finite quotes count. Adds ``_quoting``
    (members quoting that day) and ``_size`` (members of the panel).
    """
    rows = df.select(panel, member, t, value).where(f"`{value}` > 0 AND {finite(f'CAST(`{value}` AS DOUBLE)')}")
    inside = _chosen(rows, panel, member, t, coverage, min_members, min_days).where("_len <= suffix_days")
    quoted = inside.selectExpr("*", f"count(*) OVER (PARTITION BY `{panel}`, `{t}`) AS _quoting")
    start = quoted.where("_quoting = _size").groupBy(panel).agg(F.max("_len").alias("_window"))
    kept = quoted.join(start, panel).where(f"_window >= {min_days} AND _len <= _window")
    return kept.select(panel, member, t, value, "_quoting", "_size")


def matched_panel_index(
    df: DataFrame, panel: str, member: str, t: str, value: str,
    coverage: float = 0.9, min_members: int = 3, min_days: int = 10,
) -> DataFrame:
    """Mean of a fixed set of members as 100 at the window start, on days all members quote."""
    rows = matched_panel_rows(df, panel, member, t, value, coverage, min_members, min_days)
    means = (
        rows.where(F.col("_quoting") == F.col("_size"))
        .groupBy(panel, t)
        .agg(F.avg(value).alias("mean_value"), F.max("_size").alias("members"))
    )
    base = F.first("mean_value").over(_ordered([panel], t).rowsBetween(Window.unboundedPreceding, 0))
    return means.withColumn("index_value", F.lit(100) * F.try_divide(F.col("mean_value"), base))


def jump_attribution(
    rows: DataFrame, panel: str, member: str, t: str, value: str, threshold: float = 0.05
) -> DataFrame:
    """On panel moves beyond ``threshold``, the member that moved most since the previous full day.

    ``rows`` comes from :func:`matched_panel_rows`.
    """
    full = rows.where(F.col("_quoting") == F.col("_size"))
    prior = F.lag(value).over(_ordered([panel, member], t))
    moved = full.withColumn("_prior", prior).withColumn(
        "_change", F.when(F.col("_prior") > 0, F.col(value) / F.col("_prior") - 1)
    )
    mover = F.min_by(
        F.struct(member, "_change"), F.when(F.col("_change").isNotNull(), F.struct(-F.abs("_change"), F.col(member)))
    )
    daily = moved.groupBy(panel, t).agg(F.avg(value).alias("_mean"), mover.alias("_m"))
    before = F.lag("_mean").over(_ordered([panel], t))
    jump = daily.withColumn("_before", before).withColumn("_jump", F.try_divide(F.col("_mean"), F.col("_before")) - 1)
    return jump.where((F.col("_before") > 0) & (F.abs("_jump") > threshold) & F.col("_m").isNotNull()).select(
        panel,
        t,
        F.col("_jump").alias("panel_change"),
        F.col(f"_m.{member}").alias("mover"),
        F.col("_m._change").alias("mover_change"),
    )


def persistent_steps(
    df: DataFrame, panel: str, member: str, t: str, value: str,
    step: float = 0.20, steady: float = 0.10, before: int = 3, after: int = 5, skip: int = 6,
) -> DataFrame:
    """Steps of at least ``step`` with a steady run before and after, one row per step.

    After a step the next ``skip`` points of that member are passed over. Steps are tested with
    fixed-size row frames; only the (few) candidate positions of a member are folded to apply the skip.
    """
    w = _ordered([panel, member], t)
    prior = F.lag(value).over(w)
    placed = (
        df.withColumn("_i", F.row_number().over(w))
        .withColumn("_prior", prior)
        .withColumn("_head", F.collect_list(value).over(w.rowsBetween(-before, -1)))
        .withColumn("_tail", F.collect_list(value).over(w.rowsBetween(1, after)))
    )
    change = F.try_divide(F.col(value), F.col("_prior")) - 1
    calm_head = F.forall("_head", lambda x: F.abs(F.try_divide(x, F.col("_prior")) - 1) <= steady)
    calm_tail = F.forall("_tail", lambda x: F.abs(F.try_divide(x, F.col(value)) - 1) <= steady)
    steps = (
        placed.where(F.col("_prior") > 0)
        .withColumn("_change", change)
        .where(
            (F.abs("_change") >= step)
            & (F.size("_head") == before)
            & (F.size("_tail") == after)
            & calm_head
            & calm_tail
        )
    )
    found = F.array_sort(F.collect_list(F.struct("_i", t, "_change")))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))["_i"]
    empty = F.filter("_found", lambda _: F.lit(False))
    keep = F.aggregate(
        "_found",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x["_i"] >= last(acc) + skip), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    kept = steps.groupBy(panel, member).agg(found.alias("_found")).withColumn("_kept", keep)
    return kept.select(panel, member, F.inline("_kept")).select(
        panel, member, F.col(t), F.col("_change").alias("change")
    )


def step_annotations(steps: DataFrame, jumps: DataFrame, panel: str, member: str, t: str) -> DataFrame:
    """Jump labels plus persistent steps on other days; one label per day, the first member by name."""
    labelled = jumps.select(panel, t, F.col("mover").alias(member), F.col("mover_change").alias("change"))
    fresh = steps.join(labelled, [panel, t], "left_anti")
    one = fresh.groupBy(panel, t).agg(F.min_by(F.struct(member, "change"), member).alias("_s"))
    return labelled.unionByName(one.select(panel, t, f"_s.{member}", "_s.change"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
