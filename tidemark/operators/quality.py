"""Quality gates and freshness as datasets of statuses and violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.scalars import parse_day
from tidemark.operators.ordered import last_per_key


def series_quality(df: DataFrame, keys: Sequence[str], t: str, frequency: str, proxy: str) -> DataFrame:
    """Chart, inflection and 90-day eligibility of each series with its first reason code.

    ``frequency`` is daily, weekly, event or snapshot; ``proxy`` marks public proxies, which never
    pass beyond charting.
    """
    days = df.groupBy(*keys).agg(
        F.count_distinct(F.col(t)).alias("valid_dates"),
        F.min(t).alias("first_date"),
        F.max(t).alias("last_date"),
        F.max(frequency).alias("_freq"),
        F.bool_or(proxy).alias("_proxy"),
    )
    n = F.col("valid_dates")
    span = F.date_diff("last_date", "first_date")
    daily, weekly = F.col("_freq") == "daily", F.col("_freq") == "weekly"
    expected = F.when(daily, span + 1).when(weekly, F.floor(span / 7) + 1)
    graded = days.withColumn("span_days", span).withColumn("coverage_pct", n / expected * 100)
    enough = (daily & (n >= 10)) | (weekly & (n >= 8))
    chart = enough & (F.col("coverage_pct") >= 80)
    inflection = ((daily & (n >= 20) & (span >= 24)) | (weekly & (n >= 12) & (span >= 77))) & chart
    ninety = daily & (n >= 60) & (span >= 74) & chart
    open_source = ~F.col("_proxy")
    reason = (
        F.when(F.col("_freq") == "event", "event_series_only")
        .when(F.col("_freq") == "snapshot", "snapshot_only")
        .when(daily & ~enough, "insufficient_daily_history")
        .when(weekly & ~enough, "insufficient_weekly_history")
        .when(~chart, "insufficient_coverage")
        .when(F.col("_proxy"), "proxy_not_inflection_eligible")
        .when(~inflection, "insufficient_30d_history")
        .when(daily & ~ninety, "insufficient_90d_history")
    )
    no = F.lit(False)
    return graded.select(
        *keys,
        "valid_dates",
        "first_date",
        "last_date",
        "span_days",
        "coverage_pct",
        F.coalesce(chart, no).alias("eligible_for_chart"),
        F.coalesce(inflection & open_source, no).alias("eligible_for_inflection"),
        F.coalesce(ninety & open_source, no).alias("eligible_for_90d"),
        reason.alias("reason_code"),
    )


def panel_candidates(df: DataFrame, billing: str, variant: str, region: str, gpu_count: str) -> DataFrame:
    """Marks rows that state a full configuration and gives the others a rejection reason."""
    blank = reduce(
        lambda a, b: a | b,
        [F.col(c).isNull() | (F.col(c) == "") for c in (billing, variant, region)],
    ) | F.col(gpu_count).isNull()
    unknown = (F.lower(variant) == "unknown") | (F.lower(region) == "unknown") | (F.col(gpu_count) == 0)
    reason = F.when(blank, "missing_exact_configuration").when(unknown, "unstable_configuration")
    return df.withColumn("panel_reason_code", reason).withColumn("eligible", reason.isNull())


def panel_inference(candidates: DataFrame, panel: str, member: str, source: str) -> DataFrame:
    """Panels need three members and two independent sources to support market statements."""
    return (
        candidates.where("eligible")
        .groupBy(panel)
        .agg(F.count_distinct(F.col(member)).alias("members"), F.count_distinct(F.col(source)).alias("sources"))
        .withColumn("eligible_for_market_inference", (F.col("members") >= 3) & (F.col("sources") >= 2))
    )


def source_freshness(policy: DataFrame, facts: DataFrame, key: str, seen_at: str, limit_hours: str, now: Column) -> DataFrame:
    """Fresh, stale or missing per policy from the age of the newest fact, in UTC hours."""
    newest = facts.groupBy(key).agg(F.max(seen_at).alias("latest_at"), F.count(F.lit(1)).alias("observation_rows"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("latest_at")) / 3600.0
    status = (
        F.when(F.col("age_hours").isNull(), "missing")
        .when(F.col("age_hours") > F.col(limit_hours), "stale")
        .otherwise("fresh")
    )
    return policy.join(newest, key, "left").withColumn("age_hours", age).withColumn("status", status)


def source_coverage(freshness: DataFrame, key: str, policies: Sequence[str]) -> DataFrame:
    """Counts of fresh, stale and missing among the listed policies."""
    rows = freshness.where(F.col(key).isin(list(policies)))
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "stale", "missing")])


def cache_coverage(
    df: DataFrame, universe: DataFrame, entity: str, t: str, as_of: Column, max_age: int = 150
) -> DataFrame:
    """Latest actual day, age and currency for every entity of the universe; bad days are skipped."""
    latest = df.withColumn("_d", parse_day(t)).groupBy(entity).agg(F.max("_d").alias("latest_date"))
    age = F.date_diff(as_of, F.col("latest_date"))
    return (
        universe.select(entity)
        .distinct()
        .join(latest, entity, "left")
        .withColumn("age_days", age)
        .withColumn("current", F.coalesce(F.col("age_days").between(0, max_age), F.lit(False)))
    )


def grace_status(df: DataFrame, t: str, as_of: Column, grace_days: int = 7) -> DataFrame:
    """Stale but usable while the newest day is within the grace period, else failed."""
    last = F.max(t)
    lag = F.date_diff(as_of, last)
    usable = F.coalesce(lag <= grace_days, F.lit(False))
    return df.agg(
        last.alias("last_data_date"),
        lag.alias("stale_days"),
        F.when(usable, "stale_last_good").otherwise("failed").alias("status"),
        usable.alias("publishable"),
    )


def run_status(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Fresh when every source of a run succeeded, partial when some did, failed when none did."""
    good, n = F.count_if(ok), F.count(F.lit(1))
    label = F.when(good == n, "fresh").when(good > 0, "partial").otherwise("failed")
    return df.groupBy(*keys).agg(n.alias("sources"), good.alias("ok_sources"), label.alias("status"))


def overall_status(sources: DataFrame, source: str, publishable: str, informational: Sequence[str]) -> DataFrame:
    """Ready unless a blocking source cannot be published; informational sources never block."""
    passes = F.col(source).isin(list(informational)) | F.coalesce(F.col(publishable), F.lit(False))
    ready = F.coalesce(F.bool_and(passes), F.lit(True))
    return sources.agg(F.when(ready, "ready").otherwise("degraded").alias("status"), ready.alias("publishable"))


def publish_violations(sources: DataFrame, expected: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per reason not to publish.

    ``sources(source, status, publishable)``, ``expected(source)`` and ``coverage(entity, current)``.
    A wrong source set is reported alone; otherwise statuses are checked by source class.
    """
    have, want = sources.select("source").distinct(), expected.select("source").distinct()
    missing = want.join(have, "source", "left_anti").select("source", F.lit("missing_source").alias("violation"))
    extra = have.join(want, "source", "left_anti").select("source", F.lit("unexpected_source").alias("violation"))
    set_errors = missing.unionByName(extra)

    name, status = F.col("source"), F.col("status")
    publishable = F.coalesce(F.col("publishable"), F.lit(False))
    informational = name.isin(config.INFORMATIONAL_SOURCES)
    capex = name == "sec_capex"
    tolerant = name.isin(config.STALE_TOLERANT_SOURCES) & (status == "stale_last_good")
    problem = (
        F.when(informational & ~F.coalesce(status.isin(config.INFORMATIONAL_STATUSES), F.lit(False)), "unknown_status")
        .when(capex & ~(F.coalesce(status.isin(config.CAPEX_READY_STATUSES), F.lit(False)) & publishable), "capex_not_ready")
        .when(
            ~informational & ~capex & ~((F.coalesce(status == "fresh", F.lit(False)) | F.coalesce(tolerant, F.lit(False))) & publishable),
            "not_fresh",
        )
    )
    by_class = sources.select("source", problem.alias("violation")).where("violation IS NOT NULL")
    lapsed = coverage.agg((F.count(F.lit(1)) == 0) | (F.count_if("current") < F.count(F.lit(1)))).scalar()
    cached = sources.where(capex & (status == "current_for_frequency") & lapsed).select(
        "source", F.lit("capex_cache_incomplete").alias("violation")
    )
    any_set_error = set_errors.agg(F.count(F.lit(1))).scalar()
    return set_errors.unionByName(by_class.unionByName(cached).where(any_set_error == 0))


def stamp_violations(stamp: DataFrame, expected_date: Column) -> DataFrame:
    """Problems of the run stamp itself: ``stamp(generated_at, status, publishable)``."""
    day = F.to_date(F.try_to_timestamp(F.col("generated_at")))
    checks = F.array(
        F.when(day.isNull(), "invalid_generated_at").when(day != expected_date, "wrong_generated_date"),
        F.when(
            ~(F.coalesce(F.col("status") == "ready", F.lit(False)) & F.coalesce(F.col("publishable"), F.lit(False))),
            "not_ready",
        ),
    )
    return stamp.select(F.explode(F.array_compact(checks)).alias("violation"))


def required_fields(
    df: DataFrame,
    row_id: str,
    required: Sequence[str] = (),
    dates: Sequence[str] = (),
    numbers: Sequence[str] = (),
    names: Sequence[str] = (),
    present: str | None = None,
) -> DataFrame:
    """Violations per row: absent keys, unreadable days, non-numbers and blank names.

    With ``present`` (an array of stated keys) a stated null is not absent.
    """
    checks = []
    for c in required:
        absent = ~F.array_contains(present, c) if present else F.col(c).isNull()
        checks.append(F.when(absent, F.concat(F.lit("missing:"), F.lit(c))))
    for c in dates:
        checks.append(F.when(F.col(c).isNotNull() & parse_day(c).isNull(), F.concat(F.lit("bad_date:"), F.lit(c))))
    for c in numbers:
        text = F.col(c).cast("string")
        checks.append(F.when(text.isNotNull() & text.try_cast("double").isNull(), F.concat(F.lit("non_numeric:"), F.lit(c))))
    for c in names:
        checks.append(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.concat(F.lit("blank:"), F.lit(c))))
    return df.select(row_id, F.explode(F.array_compact(F.array(*checks))).alias("violation"))


class GateError(RuntimeError):
    """A quality gate rejected its input."""


def require_none(violations: DataFrame, what: str) -> None:
    """Fails the job when any violation exists; reads at most a handful of rows."""
    sample = violations.take(5)
    if sample:
        raise GateError(f"{what}: {[row.asDict() for row in sample]}")


def min_periods(df: DataFrame, t: str, at_least: int = 52) -> DataFrame:
    """A violation row when fewer periods than required remain."""
    n = F.count_distinct(F.col(t))
    return df.agg(n.alias("periods")).where(F.col("periods") < at_least).select(
        "periods", F.lit(at_least).alias("required"), F.lit("too_few_periods").alias("violation")
    )


def local_only_violations(local_only: DataFrame, shares: DataFrame, t: str, source_hash: Column) -> DataFrame:
    """Periods kept only locally need their share history and the hash of the source they came from."""
    no_shares = local_only.join(shares.select(t).distinct(), t, "left_anti").select(
        t, F.lit("missing_share_history").alias("violation")
    )
    no_hash = local_only.where(source_hash.isNull() | (source_hash == "")).select(
        t, F.lit("missing_source_hash").alias("violation")
    )
    return no_shares.unionByName(no_hash)


def provenance_check(df: DataFrame, row_id: str) -> DataFrame:
    """Violations of the provenance contract: enumerations, confidence range, seed or mock rows."""
    kind, method = F.col("source_type"), F.col("collection_method")
    bad_kind = F.when(kind.isin(config.REJECTED_SOURCE_TYPES), "source_type_rejected").when(
        ~F.coalesce(kind.isin(config.SOURCE_TYPES), F.lit(False)), "unknown_source_type"
    )
    bad_method = F.when(
        ~F.coalesce(method.isin(config.COLLECTION_METHODS), F.lit(False)), "unknown_collection_method"
    )
    bad_confidence = F.when(
        ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_out_of_range"
    )
    return df.select(row_id, F.explode(F.array_compact(F.array(bad_kind, bad_method, bad_confidence))).alias("violation"))


def quality_events(
    failures: DataFrame, entity: str, code: str, run_id: Column, payload_hash: str, affected: Column, fetched_at: Column
) -> DataFrame:
    """One blocking event per failed entity with an id that depends only on its content."""
    suffix = F.substring(F.replace(F.col(payload_hash), F.lit("sha256:"), F.lit("")), 1, 12)
    return failures.select(
        F.concat_ws(":", run_id, F.col(entity), F.col(code), suffix).alias("event_id"),
        F.lit("error").alias("severity"),
        affected.alias("affected_key"),
        F.col(code).alias("error_code"),
        F.lit(True).alias("is_blocking"),
        F.lit(0.0).alias("confidence"),
        fetched_at.alias("fetched_at"),
    )


def size_floor(sides: Mapping[str, DataFrame], at_least: int = 100) -> DataFrame:
    """A violation row for each input with fewer rows than the floor."""
    counts = [df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("rows")) for name, df in sides.items()]
    both = reduce(lambda a, b: a.unionByName(b), counts)
    return both.where(F.col("rows") < at_least).withColumn("violation", F.lit("unexpectedly_small"))


def pipeline_health(runs: DataFrame, name: str, started: str, run_id: str) -> DataFrame:
    """Latest run of each job."""
    return last_per_key(runs, [name], [started, run_id])


def warning_count(c: str) -> Column:
    """Number of warnings given as a JSON list or as an integer; anything else is zero."""
    listed = F.size(F.from_json(F.col(c), "array<string>"))
    is_list = F.startswith(F.trim(c), F.lit("["))
    return F.when(is_list, F.greatest(listed, F.lit(0))).otherwise(
        F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    )


def ready_counts(sources: DataFrame, status: str, warnings: str, cache_age: str) -> DataFrame:
    """Healthy, degraded and ready sources, and the oldest cache age."""
    healthy = F.coalesce(F.col(status).isin("fresh", "current_for_frequency"), F.lit(False))
    degraded = healthy & (warning_count(warnings) > 0)
    return sources.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(healthy).alias("healthy"),
        F.count_if(degraded).alias("degraded"),
        (F.count_if(healthy) - F.count_if(degraded)).alias("ready"),
        F.max(cache_age).alias("oldest_cache_days"),
    )
