"""Deduplication, merges and upserts of accumulated history with a fresh collection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.scalars import complete_period
from tidemark.operators.ordered import first_per_key, last_per_key, null_safe_join
from tidemark.operators.series import collection_gaps


def merge_replace_day(prev: DataFrame, new: DataFrame, t: str, day: Column) -> DataFrame:
    """Everything of ``day`` in prev gives way to new; other days stay."""
    return prev.where(F.col(t).isNull() | (F.col(t) != day)).unionByName(new, allowMissingColumns=True)


def merge_upsert(prev: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win on their key, all other rows stay; a null in a key equals a null."""
    return _without(prev, new, keys).unionByName(new, allowMissingColumns=True)


def _without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = F.expr(" AND ".join(f"_l.`{k}` <=> _r.`{k}`" for k in keys))
    return rows.alias("_l").join(other.select(*keys).distinct().alias("_r"), on, "left_anti")


def upsert_by_name(prev: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Upsert on the business key configured for a fact table."""
    return merge_upsert(prev, new, config.UPSERT_KEYS[table])


def merge_fields(
    prev: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    present: str = "_present",
    clears: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Field-level merge: a field new states wins even when null, an absent field keeps its old value.

    Rows carry the names of their stated fields in ``present``. ``clears`` maps a trigger field to
    fields dropped when new states the trigger but not them.
    """
    both = F.col("_in_new")
    left = prev.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        *keys, *[F.col(f).alias(f"_p_{f}") for f in fields], F.col(present).alias("_p_has")
    )
    right = new.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        *keys, *[F.col(f).alias(f"_n_{f}") for f in fields], F.col(present).alias("_n_has"), F.lit(True).alias("_in_new")
    )
    joined = left.join(right, list(keys), "full_outer")
    has_new = F.coalesce(F.col("_n_has"), F.array().cast("array<string>"))
    has_old = F.coalesce(F.col("_p_has"), F.array().cast("array<string>"))
    dropped = F.array().cast("array<string>")
    for trigger, targets in (clears or {}).items():
        fired = F.coalesce(both, F.lit(False)) & F.array_contains(has_new, trigger)
        gone = F.array_except(F.array(*[F.lit(x) for x in targets]), has_new)
        dropped = F.when(fired, F.array_union(dropped, gone)).otherwise(dropped)
    columns = [
        F.when(F.array_contains(has_new, f), F.col(f"_n_{f}"))
        .when(F.array_contains(F.col("_dropped"), f), F.lit(None))
        .otherwise(F.col(f"_p_{f}"))
        .alias(f)
        for f in fields
    ]
    stated = F.array_sort(F.array_except(F.array_union(has_old, has_new), F.col("_dropped")))
    return joined.withColumn("_dropped", dropped).select(*keys, *columns, stated.alias(present))


def merge_retain_complete(
    prev: DataFrame, new: DataFrame, keys: Sequence[str], t: str, start: Column, as_of: Column
) -> DataFrame:
    """Complete periods on or after ``start`` from both sides, new winning on the key."""
    keep = (F.col(t) >= start) & complete_period(t, as_of)
    return merge_upsert(prev.where(keep), new.where(keep), keys)


def merge_group_replace(prev: DataFrame, new: DataFrame, group: str, retained: DataFrame) -> DataFrame:
    """Whole groups of prev give way where new has the group; only retained groups stay."""
    kept = _without(prev, new, [group])
    both = kept.unionByName(new).alias("_l")
    return both.join(retained.select(group).distinct().alias("_r"), F.expr(f"_l.`{group}` <=> _r.`{group}`"), "left_semi")


def first_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return first_per_key(df, keys, [seq])


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return last_per_key(df, keys, [seq])


def capex_key_dedupe(df: DataFrame, t: str, company: str, metric: str, period: str, seq: str) -> DataFrame:
    """Last row per (day, company, metric, period without its cumulative suffix), all four stated."""
    base = F.trim(F.substring_index(F.col(period), " " + config.CUMULATIVE_MARK, 1))
    keyed = df.withColumn("_period", base)
    keys = [t, company, metric, "_period"]
    stated = keyed.where(
        " AND ".join(f"`{k}` IS NOT NULL AND CAST(`{k}` AS STRING) <> ''" for k in keys)
    )
    return last_per_key(stated, keys, [seq]).drop("_period")


def carry_forward(
    prev: DataFrame, new: DataFrame, key: str, origin: str, prev_run: Column
) -> DataFrame:
    """Source metadata per endpoint: new wins; carried rows get their origin run stamped once."""
    carried = prev.join(new.select(key).distinct(), key, "left_anti").withColumn(
        origin, F.coalesce(F.col(origin), prev_run)
    )
    return carried.unionByName(new, allowMissingColumns=True)


def merge_provenance(
    prev: DataFrame, new: DataFrame, t: str, start: Column, as_of: Column
) -> DataFrame:
    """One row of period counts: prior, upstream, retained, local-only and overwritten."""
    keep = (F.col(t) >= start) & complete_period(t, as_of)
    old = prev.where(keep).select(t).distinct().withColumn("_old", F.lit(True))
    upstream = new.where(keep).select(t).distinct().withColumn("_new", F.lit(True))
    periods = old.join(upstream, t, "full_outer")
    was, now = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    return periods.agg(
        F.count_if(was).alias("prior_periods"),
        F.count_if(now).alias("upstream_periods"),
        F.count(F.lit(1)).alias("retained_periods"),
        F.count_if(was & ~now).alias("local_only_periods"),
        F.count_if(now).alias("overwritten_periods"),
        F.min(F.when(was & ~now, F.col(t))).alias("first_local_only"),
    )


def canonicalize(df: DataFrame, economic: Sequence[str]) -> DataFrame:
    """One row per fully identical observation; conflicting values stay side by side."""
    return df.dropDuplicates(list(economic)).select(*economic)


def analysis_view(df: DataFrame, eligible: Column) -> DataFrame:
    return df.where(eligible)


def latest_status(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest event per affected key; the full history stays in the source table."""
    return last_per_key(df, [key], order)


def from_cache_flag(df: DataFrame, refreshed: DataFrame, keys: Sequence[str], name: str = "from_cache") -> DataFrame:
    """True unless the row's key was refreshed in this run."""
    marks = refreshed.select(*keys).distinct().withColumn("_fresh", F.lit(True))
    return null_safe_join(df, marks, keys, "left").withColumn(name, F.col("_fresh").isNull()).drop("_fresh")


def fill_missing_days(prev: DataFrame, snaps: DataFrame, t: str) -> DataFrame:
    """Adds snapshot rows only for days absent inside the covered range; never overwrites."""
    missing = collection_gaps(prev, [], t).withColumnRenamed("missing_date", t)
    return prev.unionByName(snaps.join(missing, t, "left_semi"), allowMissingColumns=True)


def unfilled_days(prev: DataFrame, snaps: DataFrame, t: str) -> DataFrame:
    """Absent days that no snapshot covers."""
    missing = collection_gaps(prev, [], t).withColumnRenamed("missing_date", t)
    return missing.join(snaps.select(t).distinct(), t, "left_anti")
