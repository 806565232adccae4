"""Order-dependent primitives that stay correct and spread out when one key holds most rows.

A window partitioned by a business key puts that key in one task. The helpers here split a key's ordered
rows into pieces, solve each piece in its own task and carry one summary row per piece across, so only
summaries meet in a single task.

Numbers that are null, NaN or infinite are no observations: quantiles and ranks leave them out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000
BANDS_PER_E_FOLD = 1 << 20
#: A key with more rows than a bound is cut into this many pieces by a sample of about as many rows as follows.
PIECES = 1024
CUT_SAMPLE = 1 << 15
STRIDE = 32
#: A key with more rows than this is ranked in pieces.
SMALL_GROUP = 200_000
#: Large keys are looked for by this many hash buckets, so that a task counts no more groups than these.
KEY_BUCKETS = 1 << 18


def quoted(names: Sequence[str], prefix: str = "") -> list[str]:
    return [f"{prefix}`{n}`" for n in names]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join keeping null keys equal; the right side's key columns are dropped."""
    on = " AND ".join(f"_l.`{k}` <=> _r.`{k}`" for k in keys) or "true"
    rest = [c for c in right.columns if c not in keys]
    return left.alias("_l").join(right.alias("_r"), F.expr(on), how).select(
        "_l.*", *quoted(rest, "_r.")
    )


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser: str, cols: Sequence[str] | None) -> DataFrame:
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    row, by = f"struct({', '.join(quoted(cols))})", f"struct({', '.join(quoted(order))})"
    out = df.groupBy(*keys).agg(F.expr(f"{chooser}({row}, {by}) AS _row"))
    kept = [c for c in df.columns if c in set(keys) | set(cols)]
    return out.selectExpr(*[f"`{c}`" if c in keys else f"_row.`{c}`" for c in kept])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols=None) -> DataFrame:
    """The row with the greatest order per key, combined map-side instead of ranked in one task."""
    return _pick(df, keys, order, "max_by", cols)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols=None) -> DataFrame:
    """The row with the least order per key, combined map-side instead of ranked in one task."""
    return _pick(df, keys, order, "min_by", cols)


def cut_in_order(
    rows: DataFrame, keys: Sequence[str], sizes: DataFrame, order: Sequence[str], name: str = "_piece", pieces: int = PIECES, sample: int = CUT_SAMPLE
) -> DataFrame:
    """Adds a piece number that never decreases in the ``order`` of a key; the pieces of a key are about equal.

    ``sizes`` gives each key's number of rows as ``_rows``. A hash of the ordered values draws about ``sample``
    rows of a key, however they lie; ``pieces - 1`` of them, equally far apart in order, are its cuts. A row's
    piece is found from every ``STRIDE``-th cut first and then from those between. Rows alike in ``order`` share
    a piece.
    """
    by, spot = quoted(keys), f"struct({', '.join(f'{o} AS _o{i}' for i, o in enumerate(order))})"
    hashed = f"pmod(xxhash64({', '.join(order)}), {1 << 30}) < {sample << 30} / _rows"
    placed = rows.selectExpr("*", f"{spot} AS _spot")
    drawn = null_safe_join(placed, sizes, keys).where(hashed).groupBy(*keys).agg(F.expr("array_sort(collect_list(_spot)) AS _drawn"))
    cuts = drawn.where("size(_drawn) > 0").selectExpr(*by, f"transform(sequence(1, {pieces} - 1), i -> _drawn[CAST(i * size(_drawn) div {pieces} AS INT)]) AS _cuts")
    far = cuts.selectExpr(*by, f"filter(_cuts, (c, i) -> (i + 1) % {STRIDE} = 0) AS _far")
    near = cuts.selectExpr(*by, "_cuts", f"explode(sequence(0, {pieces // STRIDE} - 1)) AS _past").selectExpr(*by, "_past", f"slice(_cuts, {STRIDE} * _past + 1, {STRIDE}) AS _near")
    passed = null_safe_join(placed, far, keys, "left").selectExpr(*quoted(rows.columns), "_spot", "IF(_far IS NULL, 0, size(filter(_far, c -> c < _spot))) AS _past")
    within = f"{STRIDE} * _past + IF(_near IS NULL, 0, size(filter(_near, c -> c < _spot)))"
    return null_safe_join(passed, near, [*keys, "_past"], "left").selectExpr(*quoted(rows.columns), f"{within} AS `{name}`")


def split_by_size(df: DataFrame, keys: Sequence[str], bound: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of keys with at most ``bound`` rows, those of the others, and the sizes of the others."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(f"_rows > {bound}")
    if not keys:
        return df.where("false"), df, large
    on = F.expr(" AND ".join(f"_l.`{k}` <=> _r.`{k}`" for k in keys))
    side = lambda how: df.alias("_l").join(large.alias("_r"), on, how)
    return side("left_anti"), side("left_semi"), large


def lag_in_order(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    seq: str,
    cols: Sequence[str],
    prefix: str = "prev_",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Previous row's ``cols`` per key in ``(t, seq)`` order, where ``seq`` is a unique integer per (key, t).

    Keys of at most ``chunk_rows`` rows are ordered whole. The others are cut into about equal pieces,
    wherever their numbers lie; each piece's last row is carried to the next.
    """
    small, rest, large = split_by_size(df, keys, chunk_rows)
    row = f"struct({', '.join(quoted(cols))})"
    across = f"PARTITION BY {', '.join(quoted(keys))} " if keys else ""
    named = lambda source: [f"{source}.`{c}` AS `{prefix}{c}`" for c in cols]
    whole = small.selectExpr(*quoted(df.columns), f"lag({row}) OVER ({across}ORDER BY `{t}`, `{seq}`) AS _before")
    piece = [*keys, "_piece"]
    per_piece = ", ".join(quoted(piece))
    cut = cut_in_order(rest, keys, large, quoted([t, seq]))
    lagged = cut.selectExpr(
        "*",
        f"lag({row}) OVER (PARTITION BY {per_piece} ORDER BY `{t}`, `{seq}`) AS _inside",
        f"row_number() OVER (PARTITION BY {per_piece} ORDER BY `{t}`, `{seq}`) = 1 AS _head",
    )
    tails = cut.groupBy(*piece).agg(F.expr(f"max_by({row}, struct(`{t}`, `{seq}`)) AS _tail"))
    carried = tails.selectExpr(*quoted(piece), f"lag(_tail) OVER ({across}ORDER BY _piece) AS _carried")
    joined = null_safe_join(lagged, carried, piece, "left").selectExpr(*quoted(df.columns), "IF(_head, _carried, _inside) AS _before")
    return whole.unionByName(joined).selectExpr(*quoted(df.columns), *named("_before"))


def finite(value: str) -> str:
    """SQL that holds for numbers that are neither null, NaN nor infinite."""
    return f"({value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('Infinity'))"


def value_band(value: str, per_e_fold: int = BANDS_PER_E_FOLD) -> str:
    """SQL of an integer that never decreases as the finite value grows: logarithmic bands around zero."""
    size = f"CAST(floor(ln(abs({value})) * {per_e_fold}) + {800 * per_e_fold} AS BIGINT)"
    return f"CASE WHEN {value} > 0 THEN {size} WHEN {value} < 0 THEN -{size} ELSE 0 END"


def _ranks(p: float, method: str) -> tuple[str, str, str]:
    """SQL of the one-based lower rank, upper rank and weight of the upper one among ``_n`` values."""
    if method == "inclusive":
        h = f"((_n - 1) * {p}D + 1)"
        low = f"floor({h})"
    elif method == "exclusive":
        h = f"((_n + 1) * {p}D)"
        low = f"greatest(1, least(floor({h}), _n - 1))"
    else:
        raise ValueError(f"unknown quantile method {method}")
    return low, f"least({low} + 1, _n)", f"({h} - {low})"


EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SPREAD = {"_low": ("min(_v)", "min"), "_high": ("max(_v)", "max"), "_sum": ("sum(_v * _c)", "sum")}
STATS = {"count": "_n", "min": "_low", "max": "_high", "sum": "_sum", "avg": "_sum / _n"}


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, tuple[float, str]],
    stats: Mapping[str, str] | None = None,
    small: int = 0,
) -> DataFrame:
    """Exact quantiles per key without gathering a large key's values in one task.

    ``wanted`` maps an output column to ``(probability, "inclusive" | "exclusive")``; ``stats`` maps output
    columns to ``count``, ``min``, ``max``, ``sum`` or ``avg`` of the same finite values. Equal values are
    counted map-side first. Keys of at most ``small`` different values are ordered whole, which is cheaper
    where keys are many; 0 suits few large keys. The values of all others fall into bands of a millionth of
    their size, the bands are totalled per key, those that hold a wanted rank are located from the totals, and
    only their values are ordered, each band on its own. One task orders a key's bands (a million for each
    factor of e that its values span, at most) or the different values of one band. Values are totalled per
    hash bucket of keys instead of per key, so keys that share a bucket with a large one go through bands too.
    """
    by, whole = quoted(keys), f"PARTITION BY {', '.join(quoted(keys))} " if keys else ""
    used = {c: SPREAD[c] for c in SPREAD if any(c in STATS[k] for k in (stats or {}).values())}
    edges = {name: _ranks(p, method) for name, (p, method) in wanted.items()}
    counted = (
        df.selectExpr(*by, f"CAST(`{value}` AS DOUBLE) AS _v")
        .where(finite("_v"))
        .groupBy(*keys, "_v")
        .count()
        .withColumnRenamed("count", "_c")
        .where("_c > 0")  # always holds; keeps the joins below from moving under the count, which would read the input anew
    )
    ends = []
    at = lambda rank: f"max(CASE WHEN {rank} > _from AND {rank} <= _from + _c THEN _v END)"
    for i, (low, high, weight) in enumerate(edges.values()):
        ends += [f"{at(low)} AS _a{i}", f"{at(high)} AS _b{i}", f"max({weight}) AS _w{i}"]
    pick = [F.expr(e) for e in [*ends, *(f"max({c}) AS {c}" for c in ("_n", *used))]]

    split = small > 0 and len(keys) > 0
    if split:
        # Both sums are asked for, so that this reads the same exchange as the rows themselves do.
        bucket = f"(xxhash64({', '.join(by)}) & {KEY_BUCKETS - 1})"  # never null, so no filter on it moves under the count
        sizes = counted.groupBy(F.expr(bucket).alias("_bucket")).agg(F.expr("least(count(*), sum(_c))").alias("_values"))
        large = F.broadcast(sizes.where(f"_values > {small}").select("_bucket"))  # at most one per ``small`` values
        side = lambda how: counted.join(large, F.expr(f"{bucket} = _bucket"), how)
        inside = f"({whole}ORDER BY _v"
        all_of = f"{inside} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        few = side("left_anti").selectExpr(
            *by,
            "_v",
            "_c",
            f"sum(_c) OVER {all_of} AS _n",
            *[f"{inner} OVER {all_of} AS {c}" for c, (inner, _) in used.items()],
            f"coalesce(sum(_c) OVER {inside} {EARLIER}), 0) AS _from",
            f"lead(_v) OVER {inside}) AS _next",
        )
        counted = side("left_semi")
    counted = counted.selectExpr("*", f"{value_band('_v')} AS _band")
    located = counted.groupBy(*keys, "_band").agg(
        F.expr("sum(_c) AS _size"), *[F.expr(f"{inner} AS {c}") for c, (inner, _) in used.items()]
    ).selectExpr(
        *by,
        "_band",
        "_size",
        f"coalesce(sum(_size) OVER ({whole}ORDER BY _band {EARLIER}), 0) AS _before",
        f"sum(_size) OVER ({whole}) AS _n",
        *[f"{outer}({c}) OVER ({whole}) AS {c}" for c, (_, outer) in used.items()],
    )
    needed = " OR ".join(f"({r} > _before AND {r} <= _before + _size)" for low, high, _ in edges.values() for r in (low, high))
    in_band = f"PARTITION BY {', '.join([*by, '_band'])} ORDER BY _v {EARLIER}"
    ranked = null_safe_join(counted, located.where(needed).drop("_size"), [*keys, "_band"]).selectExpr(
        *by, "_v", "_c", "_n", *used, f"_before + coalesce(sum(_c) OVER ({in_band}), 0) AS _from"
    )
    grouped = ranked.groupBy(*keys).agg(*pick)
    if split:
        # One row holds a lower rank, and the upper one is in that row or the next.
        here = [f"({low} > _from AND {low} <= _from + _c)" for low, _, _ in edges.values()]
        upper = [f"IF({high} <= _from + _c, _v, _next)" for _, high, _ in edges.values()]
        held = few.where(" OR ".join(here))
        if len(edges) == 1:
            (_, _, weight), = edges.values()
            found = held.selectExpr(*by, "_v AS _a0", f"{upper[0]} AS _b0", f"{weight} AS _w0", "_n", *used)
        else:
            rows = []
            for i, (_, _, weight) in enumerate(edges.values()):
                rows += [f"max(IF({here[i]}, _v, NULL)) AS _a{i}", f"max(IF({here[i]}, {upper[i]}, NULL)) AS _b{i}", f"max({weight}) AS _w{i}"]
            found = held.groupBy(*keys).agg(*map(F.expr, [*rows, *(f"max({c}) AS {c}" for c in ("_n", *used))]))
        grouped = found.unionByName(grouped)
    between = [
        f"CASE WHEN _w{i} = 0 THEN _a{i} ELSE _a{i} * (1 - _w{i}) + _b{i} * _w{i} END AS `{name}`"
        for i, name in enumerate(wanted)
    ]
    return grouped.selectExpr(*by, *between, *[f"{STATS[k]} AS `{name}`" for name, k in (stats or {}).items()])


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", stats=None, small: int = 0) -> DataFrame:
    return group_quantiles(df, keys, value, {name: (0.5, "inclusive")}, stats, small)


def rank_in_order(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    name: str = "rank",
    descending: bool = True,
    small: int = SMALL_GROUP,
) -> DataFrame:
    """Full rank per key by finite ``value``, then ``tie`` ascending, without an unbounded key in one task.

    Keys with more than ``small`` rows are cut into about equal pieces of the order of value and tie.
    """
    rows = df.where(finite(f"CAST(`{value}` AS DOUBLE)"))
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    down = f"~`{value}`" if whole else f"-`{value}`"  # the complement of a whole number never overflows
    order = [down if descending else f"`{value}`", f"`{tie}`"]
    few, rest, large = split_by_size(rows, keys, small)
    across = f"PARTITION BY {', '.join(quoted(keys))} " if keys else ""
    plain = few.selectExpr(*quoted(df.columns), f"row_number() OVER ({across}ORDER BY {', '.join(order)}) AS `{name}`")
    piece = [*keys, "_piece"]
    cut = cut_in_order(rest, keys, large, order)
    sizes = cut.groupBy(*piece).agg(F.count("*").alias("_size"))
    offsets = sizes.selectExpr(*quoted(piece), f"coalesce(sum(_size) OVER ({across}ORDER BY _piece {EARLIER}), 0) AS _earlier")
    inside = f"PARTITION BY {', '.join(quoted(piece))} ORDER BY {', '.join(order)}"
    placed = null_safe_join(cut, offsets, piece).selectExpr(*quoted(df.columns), f"_earlier + row_number() OVER ({inside}) AS `{name}`")
    return plain.unionByName(placed).withColumn(name, F.col(name).cast("bigint"))
