"""Aggregations: medians with one vote per entity, books, depth, shares, weighted prices, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.scalars import price_tier
from tidemark.operators.ordered import SMALL_GROUP, group_median, group_quantiles, null_safe_join


def entity_medians(df: DataFrame, keys: Sequence[str], entity: str, value: str, name: str = "median") -> DataFrame:
    """Median of each entity's values per key: one vote per entity, in long form."""
    return group_median(df, [*keys, entity], value, name, small=SMALL_GROUP)


def two_level_median(df: DataFrame, keys: Sequence[str], entity: str, value: str) -> DataFrame:
    """Median of entity medians per key with the spread of the votes.

    Quartiles use the exclusive rule and stay null below four entities; ``synthetic`` marks an even
    count, where the median is nobody's own price.
    """
    votes = entity_medians(df, keys, entity, value, "_vote")
    spread = group_quantiles(
        votes,
        keys,
        "_vote",
        {"value": (0.5, "inclusive"), "p25": (0.25, "exclusive"), "p75": (0.75, "exclusive")},
        {"low": "min", "high": "max", "average": "avg", "entity_count": "count"},
        SMALL_GROUP,
    )
    enough = F.col("entity_count") >= 4
    return (
        spread.withColumn("p25", F.when(enough, F.col("p25")))
        .withColumn("p75", F.when(enough, F.col("p75")))
        .withColumn("synthetic", F.col("entity_count") % 2 == 0)
    )


def entity_map(votes: DataFrame, keys: Sequence[str], entity: str, value: str, name: str = "entity_values") -> DataFrame:
    """Entity -> value map per key for display rows; input is one row per (key, entity)."""
    pairs = F.collect_list(F.struct(F.col(entity).cast("string"), F.col(value)))
    return votes.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias(name))


def comparable_offers(
    df: DataFrame, family: str, kind: str, price: str,
    families: Sequence[str] = config.FRONTIER, kinds: Sequence[str] = config.RENTAL_KINDS,
) -> DataFrame:
    """Offers that may enter a pooled price: a frontier family, rented without interruption, priced above zero."""
    rented = F.lower(F.coalesce(F.col(kind), F.lit(""))).isin([k.lower() for k in kinds])
    return df.where(F.col(family).isin(list(families)) & rented & (F.col(price) > 0))


def pooled_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "value") -> DataFrame:
    """One median over all offers of a key, however unevenly entities quote."""
    return group_median(df, keys, value, name)


def quartiles_exclusive(df: DataFrame, keys: Sequence[str], value: str, below_four: str = "median") -> DataFrame:
    """Quartiles at rank p(n+1); with fewer than four values the median or null stands in."""
    q = group_quantiles(
        df,
        keys,
        value,
        {"p25": (0.25, "exclusive"), "p50": (0.5, "inclusive"), "p75": (0.75, "exclusive")},
        {"n": "count"},
    )
    stand_in = F.col("p50") if below_four == "median" else F.lit(None).cast("double")
    enough = F.col("n") >= 4
    return q.withColumn("p25", F.when(enough, F.col("p25")).otherwise(stand_in)).withColumn(
        "p75", F.when(enough, F.col("p75")).otherwise(stand_in)
    )


def quartiles_inclusive(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles at rank (n-1)p+1, the SQL continuous kind."""
    return group_quantiles(
        df,
        keys,
        value,
        {"p25": (0.25, "inclusive"), "p50": (0.5, "inclusive"), "p75": (0.75, "inclusive")},
    )


def book_summary(
    df: DataFrame,
    keys: Sequence[str],
    price: str,
    gpus: str | None = None,
    provider: str | None = None,
    server_total: str | None = None,
) -> DataFrame:
    """Order-book row per key: count, five price points, GPU total, providers and truncation."""
    prices = group_quantiles(
        df,
        keys,
        price,
        {"p25_price": (0.25, "exclusive"), "median_price": (0.5, "inclusive"), "p75_price": (0.75, "exclusive")},
        {"offer_count": "count", "min_price": "min", "max_price": "max"},
    )
    enough = F.col("offer_count") >= 4
    for c in ("p25_price", "p75_price"):
        prices = prices.withColumn(c, F.when(enough, F.col(c)).otherwise(F.col("median_price")))
    null_long = F.lit(None).cast("long")
    extras = (
        df.where(F.col(price).isNotNull())
        .groupBy(*keys)
        .agg(
            (F.sum(gpus).cast("long") if gpus else F.max(null_long)).alias("gpu_count_total"),
            (F.count_distinct(F.col(provider)) if provider else F.max(null_long)).alias("provider_count"),
            (F.max(server_total).cast("long") if server_total else F.max(null_long)).alias("server_total"),
        )
    )
    out = null_safe_join(prices, extras, keys)
    return out.withColumn(
        "truncated", F.coalesce(F.col("server_total") > F.col("offer_count"), F.lit(False))
    )


def sum_per_period(df: DataFrame, t: str, value: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Total per day (and ``by``) over rows that state a whole number and a day; nulls are not zero."""
    known = df.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(t, *by).agg(F.sum(value).alias(name or value))


def daily_depth(df: DataFrame, t: str, offers: str) -> DataFrame:
    """One row: number of valid days and the total of the latest one."""
    daily = sum_per_period(df, t, offers)
    return daily.agg(F.count(F.lit(1)).alias("valid_dates"), F.max_by(offers, t).alias("latest_total"))


def depth_by_source(df: DataFrame, t: str, source: str, offers: str) -> DataFrame:
    known = df.withColumn(source, F.coalesce(F.col(source), F.lit("unknown")))
    return sum_per_period(known, t, offers, [source])


def latest_total(df: DataFrame, t: str, value: str, name: str = "latest_total") -> DataFrame:
    """Total of the latest day that states any number."""
    return sum_per_period(df, t, value).agg(F.max_by(value, t).alias(name))


def coverage_counts(df: DataFrame, provider: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(provider)).alias("providers"))


def availability_pct(df: DataFrame, keys: Sequence[str], available: str, total: str) -> DataFrame:
    """Ratio of sums, not a mean of ratios; rows without a positive total do not count."""
    return (
        df.where(F.col(total) > 0)
        .groupBy(*keys)
        .agg((F.lit(100) * F.sum(F.coalesce(available, F.lit(0))) / F.sum(total)).alias("availability_pct"))
    )


def breadth(df: DataFrame, keys: Sequence[str], provider: str, total: str) -> DataFrame:
    """Providers reporting stock per key; none is null rather than zero."""
    stocked = F.count_distinct(F.when(F.col(total) > 0, F.col(provider)))
    return df.groupBy(*keys).agg(F.nullif(stocked, F.lit(0)).alias("breadth"))


def breadth_of_map(c: str) -> Column:
    """Same count over a ``MAP<provider, [available, total]>`` cell."""
    active = F.map_filter(F.col(c), lambda _, v: (F.size(v) > 1) & (F.coalesce(F.try_element_at(v, F.lit(2)), F.lit(0)) > 0))
    return F.nullif(F.size(active), F.lit(0))


def with_residual(
    named: DataFrame, totals: DataFrame, t: str, item: str, tokens: str, total: str, residual: str = "Others"
) -> DataFrame:
    """Named rows plus one residual row per period: max(0, total - named)."""
    periods = named.groupBy(t).agg(F.sum(tokens).alias("_named"))
    rest = totals.join(periods, t, "left").select(
        t,
        F.lit(residual).alias(item),
        F.greatest(F.lit(0).cast("double"), F.col(total) - F.coalesce("_named", F.lit(0))).alias(tokens),
    )
    return named.select(t, item, F.col(tokens).cast("double").alias(tokens)).unionByName(rest)


def weekly_shares(df: DataFrame, t: str, item: str, tokens: str, residual: str = "Others") -> DataFrame:
    """Total, named total and share percent of every item in its period, residual included."""
    items = df.groupBy(t, item).agg(F.sum(tokens).alias("tokens"))
    named = F.when(F.col(item) != residual, F.col("tokens"))
    totals = items.groupBy(t).agg(
        F.sum("tokens").alias("total_tokens"), F.coalesce(F.sum(named), F.lit(0)).alias("named_tokens")
    )
    return items.join(totals, t).withColumn("share_pct", share_of(F.col("tokens"), F.col("total_tokens")))


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))


def disclosure(df: DataFrame, t: str, item: str, tokens: str, residual: str = "Others") -> DataFrame:
    """Disclosed and undisclosed share of every period."""
    rest = F.coalesce(F.sum(F.when(F.col(item) == residual, F.col(tokens))), F.lit(0))
    sums = df.groupBy(t).agg(F.sum(tokens).alias("total_tokens"), rest.alias("_rest"))
    return sums.select(
        t,
        "total_tokens",
        share_of(F.col("_rest"), F.col("total_tokens")).alias("others_share"),
        share_of(F.col("total_tokens") - F.col("_rest"), F.col("total_tokens")).alias("named_share"),
    )


def provider_shares(df: DataFrame, t: str, item: str, tokens: str, residual: str = "Others") -> DataFrame:
    """Tokens per provider (name prefix) and period, with an explicit residual row every period."""
    provider = F.when(F.col(item) == residual, residual).otherwise(F.substring_index(item, "/", 1))
    sums = df.groupBy(t, provider.alias("provider")).agg(F.sum(tokens).alias("tokens"))
    zero = df.select(t).distinct().select(t, F.lit(residual).alias("provider"), F.lit(0).alias("tokens"))
    filled = sums.unionByName(zero).groupBy(t, "provider").agg(F.sum("tokens").alias("tokens"))
    totals = df.groupBy(t).agg(F.sum(tokens).alias("_total"))
    return (
        filled.join(totals, t)
        .withColumn("share_pct", F.when(F.col("_total") != 0, F.col("tokens") / F.col("_total") * 100))
        .drop("_total")
    )


def weighted_price(
    df: DataFrame, t: str, weight: str, price: str, named: Column | None = None
) -> DataFrame:
    """Volume-weighted price over priced rows, with the share of volume it covers.

    ``named`` marks rows that count as disclosed for the second coverage figure.
    """
    w, p = F.col(weight), F.col(price)
    is_named = named if named is not None else F.lit(True)
    sums = df.groupBy(t).agg(
        F.sum(F.when(p.isNotNull(), w * p)).alias("_cost"),
        F.sum(F.when(p.isNotNull(), w)).alias("_priced"),
        F.sum(w).alias("_total"),
        F.sum(F.when(is_named, w)).alias("_named"),
        F.sum(F.when(is_named & p.isNotNull(), w)).alias("_priced_named"),
    )
    return sums.select(
        t,
        F.when(F.col("_priced") != 0, F.col("_cost") / F.col("_priced")).alias("weighted_price"),
        F.when(F.col("_priced") != 0, F.col("_priced") / F.col("_total") * 100).alias("coverage_pct"),
        F.when(F.col("_named") != 0, F.coalesce("_priced_named", F.lit(0)) / F.col("_named") * 100).alias(
            "named_coverage_pct"
        ),
    )


def tier_share(df: DataFrame, t: str, weight: str, price: str, tiers: Sequence[str]) -> DataFrame:
    """Share of volume per price tier; every tier of every period is present, zero-filled."""
    tiered = df.groupBy(t).pivot("_tier", list(tiers)) if "_tier" in df.columns else (
        df.withColumn("_tier", price_tier(price)).groupBy(t).pivot("_tier", list(tiers))
    )
    wide = tiered.agg(F.sum(weight)).na.fill(0)
    total = reduce(lambda a, b: a + b, [F.col(f"`{x}`") for x in tiers])
    cells = F.array(
        *[F.struct(F.lit(x).alias("tier"), share_of(F.col(f"`{x}`"), total).alias("share_pct")) for x in tiers]
    )
    return wide.select(t, F.inline(cells))


def conditional_medians(
    df: DataFrame, keys: Sequence[str], metric: str, value: str, metrics: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One median column per output name over the rows whose metric is in its list.

    A row goes to every output that lists its metric, and once to none, which keeps keys without any.
    """
    outputs = F.array(F.lit(""), *[F.when(F.col(metric).isin(list(names)), F.lit(out)) for out, names in metrics.items()])
    tagged = df.select(*keys, F.col(value).cast("double").alias("_x"), F.explode(F.array_compact(outputs)).alias("_out"))
    held = tagged.withColumn("_x", F.when(F.col("_out") == "", 0.0).otherwise(F.col("_x")))
    medians = group_median(held, [*keys, "_out"], "_x", "_m")
    return medians.groupBy(*keys).agg(*[F.max(F.when(F.col("_out") == out, F.col("_m"))).alias(out) for out in metrics])


def conditional_extremes(
    df: DataFrame, keys: Sequence[str], metric: str, value: str, low: Sequence[str], high: Sequence[str]
) -> DataFrame:
    """Least value among one metric set and greatest among another."""
    m, v = F.col(metric), F.col(value)
    return df.groupBy(*keys).agg(
        F.min(F.when(m.isin(list(low)), v)).alias("price"), F.max(F.when(m.isin(list(high)), v)).alias("offers")
    )


def first_last(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """First and last stated value per key; a null value never wins its day."""
    at = F.when(F.col(value).isNotNull(), F.col(t))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_dates"),
        F.min(t).alias("first_date"),
        F.max(t).alias("last_date"),
        F.min_by(value, at).alias("first_value"),
        F.max_by(value, at).alias("last_value"),
    )


def revision_counts(df: DataFrame, series: str, event_type: str, change: str, t: str) -> DataFrame:
    """Distinct series first seen, revised up and revised down, with the latest event day."""
    kind, pct = F.col(event_type), F.col(change)
    revised = kind == "value_change"
    return df.agg(
        F.count_distinct(F.when(kind == "initial_observation", F.col(series))).alias("public_series"),
        F.count_distinct(F.when(revised & (pct > 0), F.col(series))).alias("positive_revisions"),
        F.count_distinct(F.when(revised & (pct < 0), F.col(series))).alias("negative_revisions"),
        F.max(t).alias("latest_event_date"),
    )


def any_flag(df: DataFrame, keys: Sequence[str], flag: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(flag).alias(name))


def distinct_text(df: DataFrame, keys: Sequence[str], c: str, name: str, separator: str = ", ") -> DataFrame:
    """Distinct codes joined in order; duplicates are dropped before they reach the key's task."""
    codes = df.select(*keys, c).where(F.col(c).isNotNull()).distinct()
    return codes.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(c)), separator).alias(name))


def grouped_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def having_distinct(df: DataFrame, keys: Sequence[str], c: str, at_least: int, latest: str) -> DataFrame:
    """Keys with at least so many distinct values of ``c``, with their count and the latest one."""
    return (
        df.groupBy(*keys)
        .agg(F.count_distinct(F.col(c)).alias("days"), F.max(latest).alias("latest"))
        .where(F.col("days") >= at_least)
    )


def coverage_top(df: DataFrame, item: str, t: str, value: str, n: int = 8) -> DataFrame:
    """Items present on nearly every day, ranked by days, total and latest value."""
    by_day = df.groupBy(item, t).agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    ends = by_day.groupBy(item).agg(
        F.sum("_rows").alias("days"), F.sum("_sum").alias("total"), F.max(t).alias("_last"), F.max_by("_sum", t).alias("_sum")
    )
    last_day = ends.agg(F.max("_last")).scalar()
    latest = F.coalesce(F.when(F.col("_last") == last_day, F.col("_sum")), F.lit(0)).alias("latest")
    stats = ends.select(item, "days", "total", latest)
    floor = F.greatest(F.lit(2), stats.agg(F.max("days")).scalar() - 1)
    order = [F.desc("days"), F.desc("total"), F.desc("latest"), F.asc(item)]
    return stats.where(F.col("days") >= floor).orderBy(*order).limit(n)


def cumulative_head(
    df: DataFrame, item: str, t: str, tokens: str, residual: str = "Others",
    last_periods: int = 4, fraction: float = 0.8, n: int = 12,
) -> DataFrame:
    """Largest items of the last periods until they cover ``fraction`` of named volume, at most ``n``.

    The first item always stays. Only the top ``n`` meet in the running sum.
    """
    by_period = df.groupBy(t, item).agg(F.sum(tokens).alias("_sum"))
    recent = by_period.select(t).distinct().orderBy(F.desc(t)).limit(last_periods)
    every = by_period.join(recent, t, "left_semi").groupBy(item).agg(F.sum("_sum").alias("tokens"))
    sums = every.where(F.col(item) != residual)
    named_total = sums.agg(F.sum("tokens")).scalar()
    grand_total = every.agg(F.sum("tokens")).scalar()
    top = sums.orderBy(F.desc("tokens"), item).limit(n).select(
        item, "tokens", named_total.alias("_named"), grand_total.alias("_all")
    )
    w = Window.orderBy(F.desc("tokens"), item)
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        top.withColumn("_before", before)
        .withColumn("rank", F.row_number().over(w))
        .where((F.col("rank") == 1) | (F.col("_before") < F.col("_named") * fraction))
        .select("rank", item, "tokens", share_of(F.col("tokens"), F.col("_all")).alias("share_pct"))
    )


def change_point_counts(df: DataFrame, item: str, t: str, as_of: Column, days: int = 28) -> DataFrame:
    """Ledger points per item, in the last ``days`` and in all."""
    return df.groupBy(item).agg(
        F.count_if(F.col(t) >= F.date_sub(as_of, days)).alias("recent"), F.count(F.lit(1)).alias("total")
    )


def concentration_hhi(shares: DataFrame, t: str, share: str) -> DataFrame:
    """Herfindahl index of the latest period, residual included."""
    by_period = shares.groupBy(t).agg((F.sum(F.pow(F.col(share) / 100, F.lit(2))) * 10000).alias("_hhi"))
    return by_period.agg(F.max_by("_hhi", t).alias("hhi"))


def pearson(pairs: DataFrame, keys: Sequence[str], x: str, y: str, min_pairs: int = 5) -> DataFrame:
    """Correlation per key: null below ``min_pairs``, zero when either side does not vary."""
    n = F.count(F.lit(1))
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.when(n < min_pairs, F.lit(None)).when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), spread))
    return pairs.groupBy(*keys).agg(n.alias("pairs"), r.alias("r"))


def range_stats(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Low, high, count and last of the finite values."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return (
        df.where(ok)
        .groupBy(*keys)
        .agg(
            F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"), F.max_by(v, F.col(t)).alias("last")
        )
    )


def proxy_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return group_median(df, keys, value, "median", {"rows": "count", "low": "min"})


def date_bounds(datasets: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """First and last day over all datasets, from one aggregated row each."""
    edges = [df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")) for df, t in datasets]
    both = reduce(lambda a, b: a.unionByName(b), edges)
    return both.agg(F.min("lo").alias("min_date"), F.max("hi").alias("max_date"))


def source_divergence(df: DataFrame, series: str, t: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Spread of the series' latest values; null with fewer than two series."""
    last = df.groupBy(*by, series).agg(F.max_by(value, t).alias("_last"))
    spread = F.when(F.count("_last") >= 2, F.max("_last") - F.min("_last")).alias("divergence")
    return last.groupBy(*by).agg(spread) if by else last.agg(spread)


def unmatched_share(tiers: DataFrame, t: str, tier: str, share: str, unmatched: str = "unmatched") -> DataFrame:
    """Unmatched share of the latest period's visible total."""
    part = F.sum(F.when(F.col(tier) == unmatched, F.col(share))) / F.nullif(F.sum(share), F.lit(0.0)) * 100
    by_period = tiers.groupBy(t).agg(part.alias("_pct"))
    return by_period.agg(F.max(t).alias("date"), F.max_by("_pct", t).alias("unmatched_pct"))
