"""Joins: as-of, alias and candidate resolution, current against previous, nearest match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_column, is_free, name_candidates
from tidemark.operators.ordered import last_per_key, null_safe_join

BLOCK = 128  # matches gathered at a time


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    cols: Sequence[str],
    seq: str | None = None,
    valid: Column | None = None,
) -> DataFrame:
    """Each left row with the right row of the same key governing on its day.

    The governing row is the latest with day <= the left day (ties: the greatest ``seq``); a later
    null does not fall back to an older value. ``valid`` (over ``cols``) blanks governing rows that
    fail it. Only distinct (key, day) pairs of either side are ordered, so a window holds at most
    two rows per calendar day of a key however many rows the key has.
    """
    keys = list(keys)
    order = [t] if seq is None else [t, seq]
    points = last_per_key(right.select(*dict.fromkeys([*keys, *order, *cols])), [*keys, t], order[1:] or [t], cols)
    row = F.struct(*cols)
    days = left.select(*keys, t).distinct().select(*keys, t, F.lit(1).alias("_side"), F.lit(None).alias("_row"))
    marks = points.select(*keys, t, F.lit(0).alias("_side"), row.alias("_row"))
    w = (
        Window.partitionBy(*keys)
        .orderBy(t, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    governed = (
        marks.unionByName(days)
        .withColumn("_row", F.last("_row", ignorenulls=True).over(w))
        .where("_side = 1")
        .select(*keys, t, "_row.*")
    )
    if valid is not None:
        governed = governed.select(*keys, t, *[F.when(valid, F.col(c)).alias(c) for c in cols])
    return null_safe_join(left, governed, [*keys, t], "left")


def snapshot_on_or_before(
    weeks: DataFrame, snaps: DataFrame, week: str, t: str, cols: Sequence[str], today: Column
) -> DataFrame:
    """The latest snapshot dated on or before the week's last day, or ``today`` if earlier."""
    due = F.least(F.date_add(F.col(week), 6), today)
    left = weeks.withColumn(t, due)
    return asof_join(left, snaps, [], t, cols)


def resolve_alias(
    df: DataFrame, name: str, aliases: DataFrame, history: DataFrame, alias: str, target: str, known: str, out: str
) -> DataFrame:
    """Alias target when there is one, else the name itself when history knows it, else null."""
    hits = aliases.select(F.col(alias).alias("_alias"), F.col(target).alias("_target")).distinct()
    seen = history.select(F.col(known).alias("_known")).distinct()
    joined = df.join(hits, F.col(name) == F.col("_alias"), "left").join(
        seen, F.col(name) == F.col("_known"), "left"
    )
    return joined.withColumn(out, F.coalesce("_target", "_known")).drop("_alias", "_target", "_known")


def first_candidate_join(
    df: DataFrame, name: str, prices: DataFrame, key: str, input_col: str, output_col: str
) -> DataFrame:
    """Per-million prices of the first candidate key that carries any price.

    Names are resolved once each. A ``:free`` name is zero by definition and never looked up.
    """
    names = df.select(F.col(name).alias("_name")).distinct()
    candidates = names.where(~is_free("_name")).select(
        "_name", F.posexplode(name_candidates("_name")).alias("_pos", "_key")
    )
    cost_in = F.col(input_col).try_cast("double")
    cost_out = F.col(output_col).try_cast("double")
    bad = (F.col(input_col).isNotNull() & cost_in.isNull()) | (F.col(output_col).isNotNull() & cost_out.isNull())
    usable = prices.where((cost_in.isNotNull() | cost_out.isNotNull()) & ~bad).select(
        F.col(key).alias("_key"),
        (cost_in * 1_000_000).alias("input_price"),
        (cost_out * 1_000_000).alias("output_price"),
    )
    best = (
        candidates.join(usable, "_key")
        .groupBy("_name")
        .agg(F.min_by(F.struct("input_price", "output_price", F.col("_key").alias("matched_key")), "_pos").alias("_m"))
        .select("_name", "_m.*")
    )
    free = names.where(is_free("_name")).select(
        "_name",
        F.lit(0.0).alias("input_price"),
        F.lit(0.0).alias("output_price"),
        F.lit("free_variant").alias("matched_key"),
    )
    return df.join(best.unionByName(free), F.col(name) == F.col("_name"), "left").drop("_name")


def current_with_previous(
    df: DataFrame, entity: str, t: str, metric: str, value: str, mark: str = "_previous_", joint: str = "_"
) -> DataFrame:
    """Current metric values beside their published previous values of the same entity and day."""
    is_previous = F.contains(F.col(metric), F.lit(mark))
    known = df.where(F.col(value).isNotNull())
    previous = known.where(is_previous).select(
        entity, t, F.replace(F.col(metric), F.lit(mark), F.lit(joint)).alias(metric), F.col(value).alias("previous_value")
    )
    current = known.where(~is_previous).select(entity, t, metric, F.col(value).alias("current_value"))
    return current.join(previous, [entity, t, metric], "inner")


def left_join_where(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Left join whose constant predicate stays in ON, so unmatched left rows survive."""
    return left.join(right, on, "left")


def on_latest(df: DataFrame, t: str, among: DataFrame | None = None) -> DataFrame:
    """Rows dated at the latest day of ``among`` (default: of the rows themselves)."""
    latest = (among if among is not None else df).agg(F.max(t)).scalar()
    return df.where(F.col(t) == latest)


def restrict_to(df: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(selected, list(keys), "left_semi")


def ratio_to_base(df: DataFrame, series: str, t: str, value: str, base: str) -> DataFrame:
    """Other series over the base series on days both have a value and the base is not zero.

    One pass: a day's rows, one per series, see the day's base in a window.
    """
    floor = F.max(F.when((F.col(series) == base) & (F.col(value) != 0), F.col(value))).over(Window.partitionBy(t))
    return (
        df.withColumn("_base", floor)
        .where((F.col(series) != base) & F.col(value).isNotNull() & F.col("_base").isNotNull())
        .select(t, series, (F.col(value) / F.col("_base")).alias("ratio"))
    )


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def with_candidate(df: DataFrame, c: Column | str, out: str) -> DataFrame:
    return df.withColumn(out, name_candidates(as_column(c)))


def nearest_match(
    left: DataFrame, right: DataFrame, pair: str, t: str, value: str, within_days: int = 7
) -> DataFrame:
    """One-to-one nearest-day pairs per series pair: the shorter side drives, each day is used once.

    A day with several values keeps its least. Days of both sides more than ``within_days`` apart cannot
    compete, so a pair's merged calendar is cut there, and each stretch is folded on its own: the driving
    days in order, each taking the nearest day still free, the earlier one on a tie. A driving day carries
    the days it may take, and the fold remembers the taken days that a later one may still want, so its
    work grows with the calendar; matches are gathered in blocks.
    """
    sides = [
        df.groupBy(F.col(pair).cast("string").alias("pair"), F.col(t).alias("_t")).agg(F.min(F.col(value).cast("double")).alias("_v")).withColumn("_left", F.lit(is_left))
        for df, is_left in ((left, True), (right, False))
    ]
    days = sides[0].unionByName(sides[1]).withColumn("_day", F.unix_date("_t"))
    order = Window.partitionBy("pair").orderBy("_t", "_left")
    opens = F.coalesce(F.date_diff("_t", F.lag("_t").over(order)) > within_days, F.lit(True)).cast("int")
    whole = Window.partitionBy("pair")
    near = whole.orderBy("_day").rangeBetween(-within_days, within_days)
    drives = F.col("_left") == F.col("_left_drives")
    placed = (
        days.withColumn("_open", opens)
        .withColumn("_stretch", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_left_drives", F.count_if("_left").over(whole) <= F.count_if(~F.col("_left")).over(whole))
        .withColumn("_near", F.collect_list(F.when(~drives, F.struct("_t", "_v"))).over(near))
    )
    driver = F.array_sort(F.collect_list(F.when(drives, F.struct("_t", "_v", "_near"))))
    stretches = placed.groupBy("pair", "_left_drives", "_stretch").agg(driver.alias("_driver"))
    match = "STRUCT<d: STRUCT<_t: DATE, _v: DOUBLE>, o: STRUCT<_t: DATE, _v: DOUBLE>>"
    folded = F.expr(
        f"""aggregate(_driver,
          struct(CAST(array() AS ARRAY<DATE>) AS used, CAST(array() AS ARRAY<{match}>) AS block, CAST(array() AS ARRAY<ARRAY<{match}>>) AS blocks),
          (acc, d) -> transform(array(try_element_at(array_sort(transform(
              filter(d._near, o -> NOT array_contains(acc.used, o._t)),
              o -> struct(abs(datediff(o._t, d._t)) AS gap, o._t AS _t, o._v AS _v))), 1)),
            best -> IF(best IS NULL, acc, struct(
              concat(filter(acc.used, u -> datediff(d._t, u) <= {within_days}), array(best._t)) AS used,
              concat(IF(size(acc.block) < {BLOCK}, acc.block, array()), array(struct(struct(d._t AS _t, d._v AS _v) AS d, struct(best._t AS _t, best._v AS _v) AS o))) AS block,
              IF(size(acc.block) < {BLOCK}, acc.blocks, concat(acc.blocks, array(acc.block))) AS blocks)))[0],
          acc -> concat(flatten(acc.blocks), acc.block))"""
    )
    pairs = stretches.where("size(_driver) > 0").select("pair", "_left_drives", F.explode(folded).alias("_p"))
    pick = lambda field, is_left: F.when(F.col("_left_drives") == F.lit(is_left), F.col(f"_p.d.{field}")).otherwise(F.col(f"_p.o.{field}"))
    return pairs.select(
        "pair",
        pick("_t", True).alias("left_date"),
        pick("_t", False).alias("right_date"),
        pick("_v", True).alias("left_value"),
        pick("_v", False).alias("right_value"),
    )
