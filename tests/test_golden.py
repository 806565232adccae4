"""Literal cases with known answers for aggregates, series, merges and gates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import d, days, one, order, rows
from tidemark import config
from tidemark.operators import aggregates as A
from tidemark.operators import filings as G
from tidemark.operators import merge as M
from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators import series as S

SERIES = "s string, t date, v double"


def lit_day(text):
    return F.lit(text).cast("date")


# --- aggregates -------------------------------------------------------------------------


def test_exclusive_quartiles_and_book(spark):
    df = spark.createDataFrame([("a", float(p)) for p in (4, 1, 3, 2)] + [("b", 3.0), ("b", 2.0)], "k string, p double")
    assert rows(A.quartiles_exclusive(df, ["k"], "p"), "k", "p25", "p50", "p75") == [("a", 1.25, 2.5, 3.75), ("b", 2.5, 2.5, 2.5)]
    assert rows(A.quartiles_exclusive(df, ["k"], "p", "null"), "k", "p25") == [("a", 1.25), ("b", None)]
    many = spark.createDataFrame([("a", float(i + 1), 120) for i in range(100)], "k string, p double, total int")
    book = one(A.book_summary(many, ["k"], "p", server_total="total"))
    assert book.truncated and book.offer_count == 100 and book.server_total == 120 and book.gpu_count_total is None
    assert not one(A.book_summary(df.where("k = 'b'"), ["k"], "p")).truncated


def test_one_vote_per_entity(spark):
    quotes = [("a", 0.9), ("a", 1.0), ("a", 1.1)] + [(e, 5.0) for e in "bcde"]
    df = spark.createDataFrame([("x", *q) for q in quotes], "k string, e string, v double")
    r = one(A.two_level_median(df, ["k"], "e", "v"))
    assert (r["value"], r.entity_count, r.synthetic) == (5.0, 5, False)
    four = spark.createDataFrame([("x", e, v) for e, v in zip("abcd", (1.0, 2.0, 3.0, 4.0))], "k string, e string, v double")
    r = one(A.two_level_median(four, ["k"], "e", "v"))
    assert (r["value"], r.synthetic, r.p25) == (2.5, True, 1.25)
    three = one(A.two_level_median(four.where("e <> 'd'"), ["k"], "e", "v"))
    assert (three.p25, three.p75, three.low, three.high) == (None, None, 1.0, 3.0)
    votes = A.entity_medians(four, ["k"], "e", "v")
    assert one(A.entity_map(votes, ["k"], "e", "median")).entity_values == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}


def test_daily_depth_skips_bad_rows(spark):
    df = spark.createDataFrame(
        [(d("2026-01-01"), 10), (d("2026-01-02"), 12), (d("2026-01-03"), 10), (d("2026-01-03"), 20), (None, 5), (d("2026-01-04"), None)],
        "t date, n int",
    )
    r = one(A.daily_depth(df, "t", "n"))
    assert (r.valid_dates, r.latest_total) == (3, 30)


def test_breadth_of_map(spark):
    df = spark.createDataFrame([({"a": [1, 4], "b": [0, 0], "c": [2]},), ({},), (None,)], "m map<string, array<long>>")
    assert [r[0] for r in df.select(A.breadth_of_map("m")).collect()] == [1, None, None]


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([("w", "p/a", 60.0), ("w", "p/b", 15.0), ("w", "q/c", 5.0), ("w", "Others", 20.0)], "w string, m string, t double")
    assert sum(r.share_pct for r in A.weekly_shares(df, "w", "m", "t").collect()) == pytest.approx(100)
    assert rows(A.provider_shares(df, "w", "m", "t"), "provider", "tokens") == [("Others", 20.0), ("p", 75.0), ("q", 5.0)]
    r = one(A.disclosure(df, "w", "m", "t"))
    assert (r.others_share, r.named_share) == (20.0, 80.0)
    over = spark.createDataFrame([("w", 50.0)], "w string, total double")
    rest = A.with_residual(df.where("m <> 'Others'"), over, "w", "m", "t", "total").where("m = 'Others'")
    assert one(rest).t == 0.0


def test_weighted_price_and_tiers(spark):
    df = spark.createDataFrame([("w", 10.0, 1.0), ("w", 30.0, 5.0), ("w", 60.0, None), ("x", 5.0, None)], "w string, t double, p double")
    got = {r.w: r for r in A.weighted_price(df, "w", "t", "p").collect()}
    assert got["w"].weighted_price == 4.0 and got["w"].coverage_pct == 40.0 and got["x"].weighted_price is None
    tiers = A.tier_share(df, "w", "t", "p", config.PRICE_TIERS)
    assert tiers.count() == 10
    assert sum(r.share_pct for r in tiers.where("w = 'w'").collect()) == pytest.approx(100)


def test_cumulative_head_keeps_the_first(spark):
    df = spark.createDataFrame([(d("2026-01-05"), "big", 95.0), (d("2026-01-05"), "small", 5.0), (d("2026-01-05"), "Others", 900.0)], "t date, m string, v double")
    assert rows(A.cumulative_head(df, "m", "t", "v"), "rank", "m") == [(1, "big")]


def test_pearson_guards(spark):
    flat = [("flat", float(i), 1.0) for i in range(6)]
    few = [("few", float(i), float(i)) for i in range(4)]
    line = [("line", float(i), 2.0 * i) for i in range(6)]
    out = {r.k: r.r for r in A.pearson(spark.createDataFrame(flat + few + line, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert out["flat"] == 0.0 and out["few"] is None and out["line"] == pytest.approx(1.0)


def test_first_last_skips_nulls(spark):
    df = spark.createDataFrame([("a", d("2026-01-01"), None), ("a", d("2026-01-02"), 2.0), ("a", d("2026-01-03"), 3.0), ("a", d("2026-01-04"), None)], SERIES)
    r = one(A.first_last(df, ["s"], "t", "v"))
    assert (r.first_value, r.last_value, r.valid_dates, r.last_date) == (2.0, 3.0, 4, d("2026-01-04"))


def test_range_stats_ignores_non_finite(spark):
    df = spark.createDataFrame([("a", d("2026-01-01"), float("nan")), ("a", d("2026-01-02"), 2.0), ("a", d("2026-01-03"), float("inf"))], SERIES)
    assert tuple(one(A.range_stats(df, ["s"], "t", "v")))[1:] == (2.0, 2.0, 1, 2.0)


# --- series -----------------------------------------------------------------------------


def test_change_window(spark):
    near = [("a", d("2026-03-01"), 2.0), ("a", d("2026-03-31"), 3.0)]
    far = [("b", d("2026-01-30"), 2.0), ("b", d("2026-03-31"), 3.0)]
    lone = [("c", d("2026-03-31"), 3.0)]
    out = S.change_pct_window(spark.createDataFrame(near + far + lone, SERIES), ["s"], "t", "v", 30)
    assert rows(out) == [("a", 50.0), ("b", None), ("c", None)]


def test_change_window_takes_the_most_recent_or_the_nearest(spark):
    points = [("a", day, float(i)) for i, day in enumerate(days("2026-01-01", 60), 1)]
    df = spark.createDataFrame(points, SERIES)
    assert one(S.change_pct_window(df, ["s"], "t", "v", 30)).change_pct == pytest.approx((60 / 40 - 1) * 100)
    assert one(S.change_pct_window(df, ["s"], "t", "v", 30, pick="nearest")).change_pct == pytest.approx((60 / 30 - 1) * 100)


def test_panel_eligibility(spark):
    df = spark.createDataFrame([("a", x, 1.0) for x in days("2026-01-01", 12)] + [("b", x, 1.0) for x in days("2026-01-01", 5)], SERIES)
    got = {r.s: r for r in S.panel_summary(df, ["s"], "t", "v").collect()}
    assert (got["a"].chart_ready, got["a"].inflection_eligible, got["a"].span_days) == (True, False, 12)
    assert not got["b"].chart_ready


def test_half_window_growth(spark):
    df = spark.createDataFrame([(x, 400.0 if i < 230 else 200.0) for i, x in enumerate(days("2025-01-01", 260))], "t date, v double")
    r = one(S.half_window_growth(df, "t", "v"))
    assert (r.window_days, r.growth_pct) == (60, -50.0)
    assert one(S.half_window_growth(df.limit(3), "t", "v")).growth_pct is None


def test_recent_cuts_use_landed_order(spark):
    df = spark.createDataFrame(
        [("same", d("2026-07-01"), 0, 10.0), ("same", d("2026-07-01"), 1, 8.0), ("up", d("2026-07-01"), 0, 8.0), ("up", d("2026-07-02"), 1, 9.0),
         ("old", d("2026-01-01"), 0, 9.0), ("old", d("2026-07-02"), 1, 5.0), ("bad", None, 0, 1.0)],
        "m string, t date, seq long, v double",
    )
    assert rows(S.recent_cuts(df, ["m"], "t", "seq", "v", lit_day("2026-08-01"))) == [("same",)]


def test_runs(spark):
    label = [("q", 2026, 1), ("q", 2026, 2), ("q", 2026, 2), ("w", 2025, 4), ("w", 2026, 1), ("w", 2026, 2), ("g", 2026, 1), ("g", 2026, 3), ("g", 2026, 4)]
    df = spark.createDataFrame(label, "c string, fy int, q int")
    assert rows(S.longest_consecutive_run(df, ["c"], F.col("fy") * 4 + F.col("q"))) == [("g", 2), ("q", 2), ("w", 3)]
    ends = ["2025-03-31", "2025-09-30", "2025-12-31", "2026-03-31"]
    runs = S.latest_sequential_run(spark.createDataFrame([("m", d(e)) for e in ends], "c string, t date"), ["c"], "t")
    assert rows(runs) == [("m", 3)]


def test_partial_first_week(spark):
    schema = "t date, v double"
    weeks = days("2026-01-05", 3, 7)
    low = spark.createDataFrame(list(zip(weeks, (0.75, 5.38, 5.02))), schema)
    full = spark.createDataFrame(list(zip(weeks, (4.0, 4.2, 4.1))), schema)
    assert S.drop_partial_first(low, [], "t", "v").count() == 2
    assert S.drop_partial_first(full, [], "t", "v").count() == 3
    assert tuple(one(S.complete_period_count(low, "t", "v"))) == (2, weeks[0])
    assert tuple(one(S.complete_period_count(full, "t", "v"))) == (3, None)


def test_rebase_starts_at_100(spark):
    data = [("g", "a", d("2026-01-01"), 1.0), ("g", "a", d("2026-01-02"), 2.0), ("g", "a", d("2026-01-03"), 3.0), ("g", "b", d("2026-01-02"), 10.0), ("g", "b", d("2026-01-03"), 5.0), ("solo", "c", d("2026-01-01"), 7.0)]
    out = S.rebase_common_start(spark.createDataFrame(data, "g string, s string, t date, v double"), ["g"], "s", "t", "v")
    assert rows(out, "g", "s", "t", "value") == [
        ("g", "a", d("2026-01-02"), 100.0), ("g", "a", d("2026-01-03"), 150.0), ("g", "b", d("2026-01-02"), 100.0), ("g", "b", d("2026-01-03"), 50.0), ("solo", "c", d("2026-01-01"), 7.0),
    ]


def test_change_events_emit_no_repeats(spark):
    df = spark.createDataFrame([("m", x, i, v) for i, (x, v) in enumerate(zip(days("2026-01-01", 5), (1.0, 1.0, 2.0, 2.0, 1.0)))], "m string, t date, seq long, v double")
    out = S.change_events(df, ["m"], "t", "seq", "v")
    assert rows(out, "seq", "event_type", "prior_value", "value") == [(0, "initial_observation", None, 1.0), (2, "value_change", 1.0, 2.0), (4, "value_change", 2.0, 1.0)]


def test_window_floor_never_empties(spark):
    usage = spark.createDataFrame([(d("2026-01-10"),)], "t date")
    mixed = spark.createDataFrame([(d("2026-01-01"),), (d("2026-01-20"),)], "t date")
    old = spark.createDataFrame([(d("2025-01-01"),)], "t date")
    assert rows(S.window_floor(mixed, "t", usage, "t")) == [(d("2026-01-20"),)]
    assert rows(S.window_floor(old, "t", usage, "t")) == [(d("2025-01-01"),)]


def _suffix_brute(quotes, coverage=0.9, need=3, least=10):
    """Brute force over every suffix; quotes is {day: {member: value}}."""
    order = sorted(quotes)
    for i in range(len(order)):
        tail = order[i:]
        if len(tail) < least:
            return None
        seen = [m for day in tail for m in quotes[day]]
        good = {m for m in set(seen) if seen.count(m) >= coverage * len(tail)}
        if len(good) >= need:
            while tail and not good <= set(quotes[tail[0]]):
                tail = tail[1:]
            return (good, tail) if len(tail) >= least else None
    return None


@pytest.mark.parametrize("seed", range(4))
def test_matched_panel_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    data, truth = [], {}
    for panel in ("p", "q"):
        quotes = {}
        for i, day in enumerate(days("2026-01-01", 45)):
            for m in "abcdef":
                chance = 0.97 if (m in "abc" and i > 8) else 0.55
                if rnd.random() < chance:
                    quotes.setdefault(day, {})[m] = rnd.uniform(1, 9)
        truth[panel] = (quotes, _suffix_brute(quotes))
        data += [(panel, m, day, v) for day, q in quotes.items() for m, v in q.items()]
    df = spark.createDataFrame(data, "p string, m string, t date, v double")
    got = {}
    for r in S.matched_panel_index(df, "p", "m", "t", "v").collect():
        got.setdefault(r.p, []).append(r)
    for panel, (quotes, best) in truth.items():
        if best is None:
            assert panel not in got
            continue
        members, tail = best
        full = [x for x in tail if members <= set(quotes[x])]
        base = sum(quotes[full[0]][m] for m in members) / len(members)
        expected = {x: 100 * (sum(quotes[x][m] for m in members) / len(members)) / base for x in full}
        assert {r.t: pytest.approx(r.index_value) for r in got[panel]} == expected
        assert min(got[panel], key=lambda r: r.t).index_value == 100.0


def test_jump_names_the_mover(spark):
    quotes = [("p", m, day, 1.0) for m in "abc" for day in days("2026-01-01", 11)]
    quotes += [("p", "a", d("2026-01-12"), 1.0), ("p", "b", d("2026-01-12"), 1.6), ("p", "c", d("2026-01-12"), 1.0)]
    df = spark.createDataFrame(quotes, "p string, m string, t date, v double")
    inside = S.matched_panel_rows(df, "p", "m", "t", "v")
    r = one(S.jump_attribution(inside, "p", "m", "t", "v"))
    assert (r.t, r.mover, r.mover_change) == (d("2026-01-12"), "b", pytest.approx(0.6))


def _steps_brute(series):
    out, i = [], 1
    while i < len(series):
        (_, before), (day, now) = series[i - 1], series[i]
        head, tail = series[max(0, i - 3):i], series[i + 1:i + 6]
        hit = before > 0 and abs(now / before - 1) >= 0.2 and len(head) == 3 and len(tail) == 5
        hit = hit and all(abs(v / before - 1) <= 0.1 for _, v in head) and all(abs(v / now - 1) <= 0.1 for _, v in tail)
        if hit:
            out.append(day)
        i += 6 if hit else 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_persistent_steps_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    data, truth = [], []
    for m in "abcd":
        level, series = 10.0, []
        for i, day in enumerate(days("2026-01-01", 80)):
            if i % rnd.choice([7, 8, 11]) == 0:
                level *= rnd.choice([0.7, 1.3, 1.05])
            series.append((day, level * rnd.uniform(0.98, 1.02)))
        data += [("p", m, day, v) for day, v in series]
        truth += [(m, day) for day in _steps_brute(series)]
    out = S.persistent_steps(spark.createDataFrame(data, "p string, m string, t date, v double"), "p", "m", "t", "v")
    assert rows(out, "m", "t") == sorted(truth, key=order)
    assert truth


def test_one_label_per_day(spark):
    steps = spark.createDataFrame([("p", "b", d("2026-01-05"), 0.3), ("p", "a", d("2026-01-05"), 0.2), ("p", "a", d("2026-01-09"), 0.4)], "p string, m string, t date, change double")
    jumps = spark.createDataFrame([("p", d("2026-01-09"), 0.1, "c", 0.5)], "p string, t date, panel_change double, mover string, mover_change double")
    out = S.step_annotations(steps, jumps, "p", "m", "t")
    assert rows(out, "t", "m") == [(d("2026-01-05"), "a"), (d("2026-01-09"), "c")]


# --- merges -----------------------------------------------------------------------------


def test_replace_day(spark):
    schema = "t date, k string, v int"
    prev = spark.createDataFrame([(d("2026-01-01"), "a", 1), (d("2026-01-02"), "a", 2), (d("2026-01-02"), "b", 3)], schema)
    new = spark.createDataFrame([(d("2026-01-02"), "c", 9)], schema)
    merged = M.merge_replace_day(prev, new, "t", lit_day("2026-01-02"))
    assert rows(merged) == [(d("2026-01-01"), "a", 1), (d("2026-01-02"), "c", 9)]
    assert rows(M.merge_replace_day(merged, new, "t", lit_day("2026-01-02"))) == rows(merged)


def test_retention(spark):
    schema = "t date, v double"
    prev = spark.createDataFrame([(d("2025-06-30"), 14.0), (d("2026-06-29"), 200.0), (d("2025-01-06"), 1.0)], schema)
    new = spark.createDataFrame([(d("2026-06-29"), 210.0), (d("2026-07-13"), 5.0)], schema)
    args = (["t"], "t", lit_day("2025-06-01"), lit_day("2026-07-14"))
    merged = M.merge_retain_complete(prev, new, *args)
    assert rows(merged) == [(d("2025-06-30"), 14.0), (d("2026-06-29"), 210.0)]
    assert rows(M.merge_retain_complete(merged, new, *args)) == rows(merged)
    p = one(M.merge_provenance(prev, new, "t", *args[2:]))
    assert (p.prior_periods, p.upstream_periods, p.retained_periods, p.local_only_periods, p.overwritten_periods) == (2, 1, 2, 1, 1)


def test_group_replace(spark):
    schema = "t string, p string, v int"
    prev = spark.createDataFrame([("w1", "a", 1), ("w1", "b", 2), ("w2", "a", 3), ("w0", "a", 0)], schema)
    new = spark.createDataFrame([("w1", "c", 9), ("w9", "x", 1)], schema)
    kept = spark.createDataFrame([("w1",), ("w2",)], "t string")
    assert rows(M.merge_group_replace(prev, new, "t", kept)) == [("w1", "c", 9), ("w2", "a", 3)]


FIELDS = ["listed", "gap", "count", "avail", "error"]
FIELD_SCHEMA = "d string, g string, listed double, gap double, count double, avail double, error string, _present array<string>"


def _field_rows(spark, *items):
    return spark.createDataFrame([(k[0], k[1], *[v.get(f) for f in FIELDS], sorted(v)) for k, v in items], FIELD_SCHEMA)


def test_field_merge(spark):
    key = ("2026-10-01", "H100")
    prev = _field_rows(spark, (key, {"listed": 1.0, "gap": 10.0, "count": 23.0, "avail": 13.0}))
    args = (["d", "g"], FIELDS)
    clears = {"listed": ["error", "gap"]}
    window = _field_rows(spark, (key, {"avail": 13.5}))
    merged = M.merge_fields(prev, window, *args, clears=clears)
    r = one(merged)
    assert (r.gap, r["count"], r.avail) == (10.0, 23.0, 13.5)
    assert rows(M.merge_fields(merged, window, *args, clears=clears)) == rows(merged)
    gone = one(M.merge_fields(prev, _field_rows(spark, (key, {"listed": None})), *args, clears=clears))
    assert (gone.listed, gone.gap, gone["count"]) == (None, None, 23.0)
    assert gone["_present"] == ["avail", "count", "listed"]
    empty = M.merge_fields(prev, prev.limit(0), *args, clears=clears)
    assert rows(empty, *FIELDS) == rows(prev, *FIELDS)
    added = M.merge_fields(prev, _field_rows(spark, (("2026-10-02", "H100"), {"avail": 1.0}), ((None, "H100"), {"avail": 2.0})), *args, clears=clears)
    assert added.count() == 2


def test_capex_key(spark):
    data = [("2026-03-31", "Meta", "capex actual", "FY2026 Q1", 1.0, 0), ("2026-03-31", "Meta", "capex actual", "FY2026 Q1 累计（约6个月）", 2.0, 1), ("", "Meta", "capex actual", "FY2026 Q1", 3.0, 2)]
    out = M.capex_key_dedupe(spark.createDataFrame(data, "t string, c string, m string, p string, v double, seq int"), "t", "c", "m", "p", "seq")
    assert one(out).v == 2.0


def test_carry_forward_stamps_once(spark):
    schema = "k string, sha string, origin string"
    prev = spark.createDataFrame([("a", "1", None), ("b", "2", "run0"), ("c", "3", None)], schema)
    new = spark.createDataFrame([("c", "9", None)], schema)
    assert rows(M.carry_forward(prev, new, "k", "origin", F.lit("run1"))) == [("a", "1", "run1"), ("b", "2", "run0"), ("c", "9", None)]


def test_fill_only_absent_days(spark):
    schema = "t date, v int"
    prev = spark.createDataFrame([(d("2026-01-01"), 1), (d("2026-01-04"), 4)], schema)
    snaps = spark.createDataFrame([(d("2026-01-02"), 2), (d("2026-01-04"), 99), (d("2026-01-09"), 9)], schema)
    assert rows(M.fill_missing_days(prev, snaps, "t")) == [(d("2026-01-01"), 1), (d("2026-01-02"), 2), (d("2026-01-04"), 4)]
    assert rows(M.unfilled_days(prev, snaps, "t")) == [(d("2026-01-03"),)]


def test_canonical_rows_keep_conflicts(spark):
    df = spark.createDataFrame([("s", 1.0, "r1"), ("s", 1.0, "r2"), ("s", 2.0, "r1")], "s string, v double, run string")
    assert rows(M.canonicalize(df, ["s", "v"])) == [("s", 1.0), ("s", 2.0)]


def test_custom_rank_sorts_unlisted_last(spark):
    df = spark.createDataFrame([("c",), ("b",), ("a",)], "k string")
    assert [r.k for r in R.top_k(df, [R.custom_rank("k", ["b", "a"]), F.col("k")], 3).collect()] == ["b", "a", "c"]


# --- gates ------------------------------------------------------------------------------


def test_series_quality_ladder(spark):
    def series(name, n, freq, proxy=False, step=1):
        return [(name, x, freq, proxy) for x in days("2026-01-01", n, step)]

    data = series("short", 5, "daily") + series("chart", 12, "daily") + series("infl", 30, "daily") + series("full", 80, "daily")
    data += series("proxy", 80, "daily", True) + series("sparse", 12, "daily", step=3) + series("weekly", 13, "weekly", step=7) + series("ev", 3, "event")
    out = {r.s: r for r in Q.series_quality(spark.createDataFrame(data, "s string, t date, f string, p boolean"), ["s"], "t", "f", "p").collect()}
    assert {k: v.reason_code for k, v in out.items()} == {
        "short": "insufficient_daily_history", "chart": "insufficient_30d_history", "infl": "insufficient_90d_history", "full": None,
        "proxy": "proxy_not_inflection_eligible", "sparse": "insufficient_coverage", "weekly": None, "ev": "event_series_only",
    }
    assert out["full"].eligible_for_90d and not out["proxy"].eligible_for_inflection and out["weekly"].eligible_for_inflection


def test_cache_coverage(spark):
    df = spark.createDataFrame([("Meta", "2026-03-31"), ("Oracle", "2025-01-31"), ("Amazon", "soon")], "c string, t string")
    universe = spark.createDataFrame([(c,) for c in ("Meta", "Oracle", "Amazon")], "c string")
    got = {r.c: r.current for r in Q.cache_coverage(df, universe, "c", "t", lit_day("2026-07-01")).collect()}
    assert got == {"Meta": True, "Oracle": False, "Amazon": False}


def test_grace(spark):
    df = spark.createDataFrame([(d("2026-01-01"),)], "t date")
    assert one(Q.grace_status(df, "t", lit_day("2026-01-08"))).publishable
    assert one(Q.grace_status(df, "t", lit_day("2026-01-09"))).status == "failed"
    assert not one(Q.grace_status(df.limit(0), "t", lit_day("2026-01-09"))).publishable


def _sources(spark, **overrides):
    data = []
    for name in config.EXPECTED_SOURCES:
        status, ok = overrides.get(name, ("fresh", True))
        if status != "absent":
            data.append((name, status, ok))
    data += [(k, *v) for k, v in overrides.items() if k not in config.EXPECTED_SOURCES]
    return spark.createDataFrame(data, "source string, status string, publishable boolean")


def test_publish_gate(spark):
    expected = spark.createDataFrame([(n,) for n in config.EXPECTED_SOURCES], "source string")
    current = spark.createDataFrame([("MSFT", True)], "entity string, current boolean")
    lapsed = spark.createDataFrame([("MSFT", True), ("META", False)], "entity string, current boolean")
    check = lambda s, c=current: rows(Q.publish_violations(s, expected, c))
    assert check(_sources(spark)) == []
    assert check(_sources(spark, openrouter_usage=("absent", True))) == [("openrouter_usage", "missing_source")]
    assert check(_sources(spark, surprise=("fresh", True))) == [("surprise", "unexpected_source")]
    assert check(_sources(spark, openrouter_usage=("failed", False))) == [("openrouter_usage", "not_fresh")]
    assert check(_sources(spark, neocloud_provider_prices=("stale_last_good", True), gpu_orderbook=("failed", False))) == []
    assert check(_sources(spark, gpu_orderbook=("odd", True))) == [("gpu_orderbook", "unknown_status")]
    assert check(_sources(spark, sec_capex=("failed", True))) == [("sec_capex", "capex_not_ready")]
    cached = _sources(spark, sec_capex=("current_for_frequency", True))
    assert check(cached) == [] and check(cached, lapsed) == [("sec_capex", "capex_cache_incomplete")]
    stamp = spark.createDataFrame([("2026-07-01T00:00:00Z", "degraded", True)], "generated_at string, status string, publishable boolean")
    assert rows(Q.stamp_violations(stamp, lit_day("2026-07-02"))) == [("not_ready",), ("wrong_generated_date",)]


def test_required_fields_and_gate(spark):
    df = spark.createDataFrame([("1", None, "2026-01-01", "3", "n"), ("2", "x", "2026-13-01", "three", " ")], "id string, a string, day string, num string, name string")
    out = Q.required_fields(df, "id", ["a"], ["day"], ["num"], ["name"])
    assert rows(out) == [("1", "missing:a"), ("2", "bad_date:day"), ("2", "blank:name"), ("2", "non_numeric:num")]
    with pytest.raises(Q.GateError):
        Q.require_none(out, "rows")
    Q.require_none(out.limit(0), "rows")


def test_local_only_weeks_need_provenance(spark):
    weeks = spark.createDataFrame([("w1", "sha"), ("w2", None)], "t string, sha string")
    shares = spark.createDataFrame([("w2",)], "t string")
    assert rows(Q.local_only_violations(weeks, shares, "t", F.col("sha"))) == [("w1", "missing_share_history"), ("w2", "missing_source_hash")]


def test_warnings_as_list_or_number(spark):
    df = spark.createDataFrame([("fresh", "[\"a\"]", 3), ("current_for_frequency", "0", 9), ("failed", "4", None), ("fresh", None, None)], "s string, w string, age int")
    assert tuple(one(Q.ready_counts(df, "s", "w", "age"))) == (4, 3, 1, 2, 9)


# --- filings ----------------------------------------------------------------------------


def test_guidance_buckets_prefer_the_newest(spark):
    data = [
        ("Meta", "fy2026 capex guidance low", 130.0, d("2026-07-29"), 0, ""), ("Meta", "fy2026 capex guidance high", 145.0, d("2026-07-29"), 1, ""),
        ("Meta", "fy2026 capex guidance previous low", 125.0, d("2026-07-29"), 2, ""), ("Meta", "fy2026 capex guidance previous high", 145.0, d("2026-07-29"), 3, ""),
        ("Meta", "fy2026 capex guidance low", 125.0, d("2026-04-29"), 4, ""), ("Amazon", "calendar 2026 capex guidance", 175.0, d("2026-02-01"), 5, ""),
        ("Amazon", "cloud backlog", 9.0, d("2026-02-01"), 6, ""), ("Nobody", "fy2026 capex guidance low", 1.0, d("2026-02-01"), 7, ""),
    ]
    rows_df = spark.createDataFrame(data, "company string, metric string, value double, date date, seq int, period string")
    got = {(r.company, r.fiscal_year): r for r in G.guidance_buckets(rows_df).collect()}
    assert set(got) == {("Meta", "FY2026"), ("Amazon", "CY2026")}
    meta, amazon = got[("Meta", "FY2026")], got[("Amazon", "CY2026")]
    assert (meta.low, meta.high, meta.prev_low, meta.prev_high, meta.revision_date) == (130.0, 145.0, 125.0, 145.0, d("2026-07-29"))
    assert (amazon.low, amazon.high, amazon.prev_low) == (175.0, 175.0, None)
    assert rows(G.guidance_moves(G.guidance_buckets(rows_df))) == [("Meta", "FY2026", "up")]
    lows = {r.company: r.move for r in G.guidance_revision_low_only(rows_df).collect()}
    assert lows["Meta"] == "up" and lows["Nobody"] is None


def test_calendar_quarters_skip_cumulative_and_annual(spark):
    data = [("Microsoft", "capex actual", "FY2026 Q3", 19.0, 0), ("Microsoft", "capex actual", "FY2026 Q4", 30.1, 1), ("Microsoft", "capex actual", "FY2026 Q4 累计（约12个月）", 90.0, 2), ("Microsoft", "capex actual", "FY2026", 88.0, 3)]
    df = spark.createDataFrame(data, "company string, metric string, period string, value double, seq int")
    assert rows(G.calendar_quarterly(df), "group", "value") == [("26Q1", 19.0), ("26Q2", 30.1)]


def test_guidance_year_choice(spark):
    df = spark.createDataFrame(
        [("M", "FY2026", 1.0, d("2026-01-01")), ("M", "FY2027", 2.0, d("2026-05-01")), ("N", "FY2026", 3.0, None)], "company string, fiscal_year string, low double, revision_date date"
    )
    assert rows(G.latest_guidance_per_company(df), "company", "fiscal_year") == [("M", "FY2027"), ("N", "FY2026")]


def test_revision_counts_dates(spark):
    df = spark.createDataFrame([("s", "initial_observation", None, dt.date(2026, 1, 1)), ("s", "value_change", 5.0, dt.date(2026, 2, 1))], "s string, e string, c double, t date")
    assert tuple(one(A.revision_counts(df, "s", "e", "c", "t"))) == (1, 1, 0, dt.date(2026, 2, 1))


def test_rebase_without_groups(spark):
    df = spark.createDataFrame([("a", d("2026-01-01"), 2.0), ("a", d("2026-01-02"), 4.0), ("b", d("2026-01-02"), 5.0)], SERIES)
    out = S.rebase_common_start(df, [], "s", "t", "v")
    assert rows(out, "s", "t", "value") == [("a", d("2026-01-02"), 100.0), ("b", d("2026-01-02"), 100.0)]
