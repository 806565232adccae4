"""Column-level building blocks: classification, casting, dates, labels and identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_first_match(
    c: ColumnLike,
    rules: Sequence[tuple[str, str]],
    default: Column | str | None = None,
    fold_separators: bool = True,
) -> Column:
    """Label of the first rule whose needle occurs in the text; the input itself when no default."""
    source = as_column(c).cast("string")
    text = F.lower(F.coalesce(source, F.lit("")))
    if fold_separators:
        text = F.translate(text, "_-", "  ")
    fallback = source if default is None else (F.lit(default) if isinstance(default, str) else default)
    matched = None
    for needle, label in rules:
        hit = F.contains(text, F.lit(needle))
        matched = F.when(hit, label) if matched is None else matched.when(hit, label)
    return fallback if matched is None else matched.otherwise(fallback)


def finite(c: ColumnLike) -> Column:
    """Castable to double and neither NaN nor infinite, else null."""
    v = as_column(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def positive(c: ColumnLike) -> Column:
    """Castable to double and above zero, else null."""
    v = as_column(c).try_cast("double")
    return F.when(~F.isnan(v) & (v > 0), v)


def parse_day(c: ColumnLike) -> Column:
    """Date in the first ten characters; anything unparseable is null and never fails."""
    head = F.substring(as_column(c).cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d"))


def day_of(c: ColumnLike) -> Column:
    """Day part of a timestamp string: cut at ``T``, else at a space, else ten characters."""
    text = as_column(c).cast("string")
    return (
        F.when(F.contains(text, F.lit("T")), F.substring_index(text, "T", 1))
        .when(F.contains(text, F.lit(" ")), F.substring_index(text, " ", 1))
        .otherwise(F.substring(text, 1, 10))
    )


def parse_weekday_date(c: ColumnLike) -> Column:
    """``Mon, 03 Aug 2026 ...`` to a date; Spark has no weekday pattern, so the weekday is cut."""
    head = F.trim(F.substring(as_column(c).cast("string"), 1, 16))
    body = F.regexp_extract(head, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4})$", 1)
    return F.when(body != "", F.try_to_date(body, "d MMM yyyy"))


def per_million(c: ColumnLike) -> Column:
    """Unit price scaled to one million; negative or unparseable prices are null."""
    v = as_column(c).try_cast("double")
    return F.when(v >= 0, v * 1_000_000)


def short_name(c: ColumnLike, limit: int = 34) -> Column:
    """Last path segment without release suffixes, cut to ``limit`` with an ellipsis."""
    text = F.substring_index(F.trim(F.coalesce(as_column(c).cast("string"), F.lit(""))), "/", -1)
    for suffix in ("-preview", "-instruct"):
        text = F.replace(text, F.lit(suffix), F.lit(""))
    # The date suffixes of released names.
    text = F.regexp_replace(text, r"-20\d{6,8}$", "")
    text = F.regexp_replace(text, r"-\d{4}-\d{2}-\d{2}$", "")
    cut = F.concat(F.substring(text, 1, limit - 1), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def name_candidates(c: ColumnLike, prefix: str = "openrouter/") -> Column:
    """Ordered distinct lookup keys for a model name, from most to least specific."""
    raw = F.trim(as_column(c))
    base = F.substring_index(raw, ":", 1)
    # Fixed value: the date suffix of a key.
    undated = F.regexp_replace(base, r"-20\d{6}$", "")
    tail = F.when(
        F.contains(undated, F.lit("/")), F.substring(undated, F.locate("/", undated) + 1, F.length(undated))
    ).otherwise(undated)
    prefixed = [F.concat(F.lit(prefix), x) for x in (raw, base, undated)]
    return F.array_distinct(F.array(*prefixed, raw, base, undated, tail))


def lookup(c: ColumnLike, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a small fixed mapping as a literal map column."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), as_column(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def venue_grade(c: ColumnLike) -> Column:
    return lookup(c, config.VENUE_GRADES, config.DEFAULT_VENUE_GRADE)


def price_tier(c: ColumnLike) -> Column:
    """Tier of a price: missing is unmatched, zero is free, 1 belongs to the middle tier, 5 too."""
    p = as_column(c)
    return (
        F.when(p.isNull(), "unmatched")
        .when(p == 0, "free")
        .when(p < 1, "under_1")
        .when(p <= 5, "1_to_5")
        .otherwise("over_5")
    )


def is_free(c: ColumnLike) -> Column:
    return F.endswith(as_column(c), F.lit(":free"))


def guidance_metric(c: ColumnLike) -> Column:
    """Struct (bucket, field) of a guidance metric name; null when the name is not guidance.

    ``field`` is low, high, prev_low, prev_high or calendar.
    """
    text = as_column(c)
    # The published label formats of guidance.
    fiscal = r"^fy(\d{4})\s+capex\s+guidance(?:\s+previous)?\s+(low|high)$"
    calendar = r"^calendar\s+(\d{4})\s+capex\s+guidance$"
    fiscal_year = F.regexp_extract(text, fiscal, 1)
    bound = F.regexp_extract(text, fiscal, 2)
    calendar_year = F.regexp_extract(text, calendar, 1)
    field = F.when(F.contains(text, F.lit("previous")), F.concat(F.lit("prev_"), bound)).otherwise(bound)
    return F.when(
        fiscal_year != "",
        F.struct(F.concat(F.lit("FY"), fiscal_year).alias("bucket"), field.alias("field")),
    ).when(
        calendar_year != "",
        F.struct(F.concat(F.lit("CY"), calendar_year).alias("bucket"), F.lit("calendar").alias("field")),
    )


def fiscal_quarter(c: ColumnLike) -> Column:
    """Struct (fy, q) of a single-quarter label; cumulative and annual labels are null."""
    text = as_column(c)
    # Fixed value: the label format of a fiscal quarter.
    pattern = r"FY(\d{4})\s+Q(\d)"
    year = F.regexp_extract(text, pattern, 1)
    quarter = F.regexp_extract(text, pattern, 2)
    single = (year != "") & ~F.contains(text, F.lit(config.CUMULATIVE_MARK))
    return F.when(single, F.struct(year.try_cast("int").alias("fy"), quarter.try_cast("int").alias("q")))


def calendar_group(company: ColumnLike, fy: ColumnLike, q: ColumnLike) -> Column:
    """``yyQn`` calendar group of a company's fiscal quarter; unmapped companies are null."""
    table: dict[str, str] = {}
    shift: dict[str, str] = {}
    for name, quarters in config.FISCAL_TO_CALENDAR.items():
        for number, (label, delta) in quarters.items():
            table[f"{name}|{number}"] = label
            shift[f"{name}|{number}"] = str(delta)
    key = F.concat_ws("|", as_column(company), as_column(q).cast("string"))
    label = lookup(key, table)
    year = (as_column(fy) + lookup(key, shift).cast("int")).cast("string")
    return F.concat(F.right(year, F.lit(2)), label)


def complete_period(start: ColumnLike, as_of: Column, days: int = 7, inclusive: bool = False) -> Column:
    """The period's last day lies before ``as_of`` (or on it when ``inclusive``)."""
    last = F.date_add(as_column(start), days - 1)
    return last <= as_of if inclusive else last < as_of


def content_hash(*cols: ColumnLike) -> Column:
    """``sha256:`` plus the digest of the columns' canonical JSON, in the order given."""
    named = [as_column(c) for c in cols]
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256))


def series_id(*cols: ColumnLike) -> Column:
    """Stable identity of a series; pass only identity columns, never run metadata."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def label_case(c: ColumnLike, labels: Mapping[str, str]) -> Column:
    """Display label of a code; unknown codes show with underscores as spaces."""
    source = as_column(c)
    return F.coalesce(lookup(source, labels), F.replace(source, F.lit("_"), F.lit(" ")))


def strip_prefix(c: ColumnLike, prefix: str = "NVIDIA ") -> Column:
    return F.replace(as_column(c), F.lit(prefix), F.lit(""))


def sku_short(c: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_replace(as_column(c), "^Standard_", ""), r"_v[0-9]+$", "")


def money(c: ColumnLike, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", as_column(c)))


def price_range_text(low: ColumnLike, high: ColumnLike) -> Column:
    return F.concat(money(low), F.lit(" to "), money(high))


def effective_date(fetched_at: ColumnLike, day: ColumnLike) -> Column:
    return F.coalesce(as_column(fetched_at).cast("date"), as_column(day))


def usd_billions(c: ColumnLike) -> Column:
    return F.abs(as_column(c)) / 1e9


def array_median(c: ColumnLike) -> Column:
    """Median of a row's own array; the mean of the middle two when even."""
    ordered = F.array_sort(as_column(c))
    n = F.size(ordered)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.ceil((n + 1) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def date_range_filter(df: DataFrame, t: str, start: Column, end: Column) -> DataFrame:
    """Rows whose day lies in the inclusive window."""
    return df.where(F.col(t).between(start, end))


def matches_any(c: ColumnLike, patterns: Sequence[str]) -> Column:
    """SQL LIKE against any of the patterns."""
    test = F.lit(False)
    for pattern in patterns:
        test = test | as_column(c).like(pattern)
    return test


def focus_filter(
    df: DataFrame,
    item: str,
    focus: Sequence[str],
    value: str | None = None,
    min_abs: float | None = None,
    patterns: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The predicate set of the extracts: membership, case folding, magnitude and LIKE groups."""
    kept = df.where(F.lower(item).isin([f.lower() for f in focus]))
    if value is not None:
        kept = kept.where(F.col(value).isNotNull())
        if min_abs is not None:
            kept = kept.where(F.abs(value) >= min_abs)
    if patterns is not None:
        kept = kept.where(matches_any(patterns[0], patterns[1]))
    return kept


def indicators_to_long(
    df: DataFrame, t: str, item: str, focus: Sequence[str], specs: Mapping[str, str]
) -> DataFrame:
    """One wide row to one long row per indicator that has a number; ``specs`` maps column to dataset."""
    rows = df.where((F.length(F.col(t).cast("string")) == 10) & F.col(item).isin(list(focus)))
    picked = [F.struct(F.lit(name).alias("dataset"), finite(c).alias("value")) for c, name in specs.items()]
    return (
        rows.select(F.col(t), F.col(item).alias("series"), F.explode(F.array(*picked)).alias("_p"))
        .select(t, "series", "_p.dataset", "_p.value")
        .where(F.col("value").isNotNull())
    )


def band_to_long(df: DataFrame, t: str, bounds: Mapping[str, str], keys: Sequence[str] = (), name: str = "series") -> DataFrame:
    """A low/high pair to two series called ``name``, per ``keys``; bounds without a number are skipped."""
    picked = [F.struct(F.lit(bound).alias(name), finite(c).alias("value")) for c, bound in bounds.items()]
    return (
        df.select(*keys, F.col(t), F.explode(F.array(*picked)).alias("_p"))
        .select(*keys, t, f"_p.{name}", "_p.value")
        .where(F.col("value").isNotNull())
    )
