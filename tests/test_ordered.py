"""Skew-safe primitives against brute force."""

import datetime as dt
import random
import time
import statistics

import pytest
from pyspark.sql import functions as F

from tests.helpers import d, days, order, rows
from tidemark.operators import joins as J
from tidemark.operators import ordered as O


def _groups(seed, sizes, values):
    rnd = random.Random(seed)
    return [(k, values(rnd)) for k, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize(
    "values",
    [
        lambda r: r.gauss(0, 5),
        lambda r: float(r.randint(-3, 3)),
        lambda r: r.choice([0.0, 1e-9, 1e9, -1e9, 3.5]),
    ],
)
@pytest.mark.parametrize("small", [0, 3, 10_000])
def test_quantiles_match_brute_force(spark, values, small):
    data = _groups(3, {"hot": 900, "b": 4, "c": 3, "d": 2, "e": 1}, values)
    df = spark.createDataFrame(data, "k string, v double")
    out = O.group_quantiles(
        df, ["k"], "v",
        {"m": (0.5, "inclusive"), "q1": (0.25, "exclusive"), "q3": (0.75, "exclusive"), "i9": (0.9, "inclusive")},
        {"n": "count", "lo": "min", "hi": "max", "s": "sum", "a": "avg"},
        small,
    )
    got = {r["k"]: r for r in out.collect()}
    for k in {x for x, _ in data}:
        v = sorted(x for y, x in data if y == k)
        r = got[k]
        assert r["n"] == len(v) and r["lo"] == v[0] and r["hi"] == v[-1]
        assert r["m"] == statistics.median(v)
        assert r["s"] == pytest.approx(sum(v)) and r["a"] == pytest.approx(sum(v) / len(v))
        if len(v) >= 4:
            q = statistics.quantiles(v, n=4)
            assert r["q1"] == pytest.approx(q[0], rel=1e-9, abs=1e-9) and r["q3"] == pytest.approx(q[2], rel=1e-9, abs=1e-9)
        if len(v) >= 2:
            assert r["i9"] == pytest.approx(statistics.quantiles(v, n=10, method="inclusive")[8], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("small", [0, 1, O.SMALL_GROUP])
def test_quantiles_skip_nulls_and_keep_null_keys(spark, small):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = O.group_quantiles(df, ["k"], "v", {"m": (0.5, "inclusive")}, small=small)
    assert rows(got) == rows(spark.createDataFrame([(None, 2.0), ("b", 2.0)], "k string, m double"))


def test_quantiles_over_everything(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert rows(O.group_median(df, [], "v")) == [(50.0,)]


def test_bands_never_decrease(spark):
    rnd = random.Random(5)
    values = sorted([rnd.uniform(-1e6, 1e6) for _ in range(500)] + [0.0, 1e-300, -1e-300, 1e300, -1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bands = [r[1] for r in sorted(df.selectExpr("v", O.value_band("v")).collect())]
    assert bands == sorted(bands)


@pytest.mark.parametrize("chunk_rows", [1, 2, 7, 1000])
def test_lag_crosses_chunks(spark, chunk_rows):
    rnd = random.Random(chunk_rows)
    data, expected = [], {}
    for key in ("hot", "cold"):
        n = 60 if key == "hot" else 3
        points = [(d("2026-01-01").replace(day=rnd.randint(1, 5)), i) for i in range(n)]
        ordered = sorted(points)
        for i, (day, seq) in enumerate(ordered):
            expected[(key, day, seq)] = float(ordered[i - 1][1]) if i else None
        data += [(key, day, seq, float(seq)) for day, seq in points]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, day date, seq long, v double")
    out = O.lag_in_order(df, ["k"], "day", "seq", ["v"], chunk_rows=chunk_rows)
    assert {(r.k, r.day, r.seq): r.prev_v for r in out.collect()} == expected


def test_rank_in_order(spark):
    rnd = random.Random(9)
    data = [("w", f"m{i:03d}", float(rnd.randint(0, 40))) for i in range(200)]
    out = O.rank_in_order(spark.createDataFrame(data, "w string, m string, v double"), ["w"], "v", "m")
    expected = [m for _, m, v in sorted(data, key=lambda x: (-x[2], x[1]))]
    assert [r.m for r in sorted(out.collect(), key=lambda r: r["rank"])] == expected


def test_quantiles_leave_out_nan_and_infinity(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, float("nan"), 2.0, 3.0, 4.0, float("inf"), float("-inf"))], "v double")
    got = O.group_quantiles(df.withColumn("k", F.lit("a")), ["k"], "v", {"m": (0.5, "inclusive")}, {"n": "count", "hi": "max"})
    assert rows(got) == [("a", 2.5, 4, 4.0)]


@pytest.mark.parametrize("values", ["1.75e9D + id", "100D + id / 1e8D", "IF(id % 3 = 0, 0D, id * 1D)", "exp(id / 1e5D)"])
def test_a_million_clustered_values_fall_into_small_bands(spark, values):
    df = spark.range(1_000_000).selectExpr("'hot' AS k", f"{values} AS v")
    bands = df.distinct().selectExpr("k", f"{O.value_band('v')} AS b").groupBy("k", "b").count()
    widest, number = bands.agg(F.max("count"), F.count("*")).first()
    assert widest <= 20_000 and number <= 1_000_000
    got = O.group_quantiles(df, ["k"], "v", {"m": (0.5, "inclusive")}).first()
    assert got.m == df.selectExpr("median(v)").first()[0]


SPREADS = {"far apart": "id * 1000003 + 9007199254740993", "close, one far away": "IF(id = 0, 9000000000000000000, id)", "doubling": "shiftleft(1L, CAST(id % 40 AS INT) + 20) + id"}


@pytest.mark.parametrize("seq", SPREADS.values(), ids=SPREADS.keys())
def test_lag_of_large_keys_in_even_pieces(spark, seq):
    df = spark.range(60_000).selectExpr("'hot' AS k", "date'2026-01-01' AS day", f"{seq} AS seq").selectExpr("*", "seq * 1D AS v")
    sizes = O.cut_in_order(df, ["k"], df.groupBy("k").agg(F.count("*").alias("_rows")), ["day", "seq"]).groupBy("_piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 60_000 / O.PIECES and sizes.count() == O.PIECES
    out = O.lag_in_order(df, ["k"], "day", "seq", ["v"], chunk_rows=1_000)
    plain = df.selectExpr("seq", "lag(v) OVER (ORDER BY seq) AS want")
    assert out.join(plain, "seq").where("NOT (prev_v <=> want)").count() == 0 and out.count() == 60_000


@pytest.mark.parametrize("tie", ["IF(id = 0, 'a', concat('model-', lpad(id, 9, '0')))", "IF(id = 0, -9000000000000000000, id)"])
def test_rank_of_one_value_in_even_pieces(spark, tie):
    df = spark.range(60_000).selectExpr("'hot' AS w", f"{tie} AS m", "7D AS v")
    sizes = O.cut_in_order(df, ["w"], df.groupBy("w").agg(F.count("*").alias("_rows")), ["-v", "m"]).groupBy("_piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 60_000 / O.PIECES
    out = O.rank_in_order(df, ["w"], "v", "m", small=1_000)
    plain = df.selectExpr("m", "row_number() OVER (ORDER BY m) AS want")
    assert out.join(plain, "m").where("rank <> want").count() == 0 and out.count() == 60_000


def test_rank_over_everything_and_extreme_numbers(spark):
    df = spark.createDataFrame([("a", -(2**63)), ("b", 2**63 - 1), ("c", 0), ("d", 0)], "m string, v long")
    for small in (1, 100):
        assert [r.m for r in O.rank_in_order(df, [], "v", "m", small=small).orderBy("rank").collect()] == ["b", "c", "d", "a"]
    assert O.rank_in_order(df.limit(0), [], "v", "m").count() == 0


@pytest.mark.parametrize("tie", ["string", "long"])
@pytest.mark.parametrize("descending", [True, False])
def test_split_keys_give_the_same_ranks(spark, tie, descending):
    rnd = random.Random(11)
    data = [(k, f"model-{i:05d}" if tie == "string" else i, rnd.choice([0.0, 0.0, 0.0, 5.0, rnd.gauss(0, 3), 1.75e9 + rnd.random()])) for k, n in (("hot", 3000), ("b", 3)) for i in range(n)]
    data.append(("hot", "nan" if tie == "string" else -1, float("nan")))
    rnd.shuffle(data)
    df = spark.createDataFrame(data, f"w string, m {tie}, v double")
    split = O.rank_in_order(df, ["w"], "v", "m", descending=descending, small=2)
    assert rows(split) == rows(O.rank_in_order(df, ["w"], "v", "m", descending=descending))
    expected = [m for w, m, v in sorted((x for x in data if x[0] == "hot" and x[2] == x[2]), key=lambda x: (-x[2] if descending else x[2], x[1]))]
    assert [r.m for r in sorted(split.where("w = 'hot'").collect(), key=lambda r: r["rank"])] == expected


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 5, "y")], "k string, seq int, v string")
    assert rows(O.first_per_key(df, ["k"], ["seq"])) == rows(spark.createDataFrame([("a", 1, None), ("b", 5, "y")], df.schema))
    assert rows(O.last_per_key(df, ["k"], ["seq"])) == [("a", 2, "x"), ("b", 5, "y")]


def test_asof_takes_the_governing_point_even_when_null(spark):
    left = spark.createDataFrame([("m", d("2026-01-05")), ("m", d("2026-01-20")), ("m", d("2025-01-01")), ("z", d("2026-01-05"))], "m string, t date")
    right = spark.createDataFrame(
        [("m", d("2026-01-01"), 0, 1.0), ("m", d("2026-01-05"), 0, 2.0), ("m", d("2026-01-05"), 1, 3.0), ("m", d("2026-01-10"), 0, None)],
        "m string, t date, seq int, p double",
    )
    out = J.asof_join(left, right, ["m"], "t", ["p"], "seq")
    got = {(r.m, r.t): r.p for r in out.collect()}
    assert got == {("m", d("2026-01-05")): 3.0, ("m", d("2026-01-20")): None, ("m", d("2025-01-01")): None, ("z", d("2026-01-05")): None}


def test_asof_blanks_invalid_prices(spark):
    left = spark.createDataFrame([("m", d("2026-01-05"))], "m string, t date")
    right = spark.createDataFrame([("m", d("2026-01-01"), 1.0), ("m", d("2026-01-04"), -1.0)], "m string, t date, p double")
    out = J.asof_join(left, right, ["m"], "t", ["p"], valid=F.col("p") >= 0)
    assert rows(out, "p") == [(None,)]


def _greedy(a, b, within=7):
    """Brute force: shorter side in day order, nearest unused day, earlier on ties."""
    flip = len(a) > len(b)
    drive, other = (b, a) if flip else (a, b)
    used, pairs = set(), []
    for day, value in sorted(drive):
        options = sorted((abs((o - day).days), o, w) for o, w in other if o not in used and abs((o - day).days) <= within)
        if options:
            _, o, w = options[0]
            used.add(o)
            pairs.append((o, day, w, value) if flip else (day, o, value, w))
    return pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_match(spark, seed):
    rnd = random.Random(seed)
    left, right, expected = [], [], []
    for pair in ("p", "q"):
        a = [(x, float(i)) for i, x in enumerate(rnd.sample(days("2026-01-01", 90), 20 if pair == "p" else 30))]
        b = [(x, float(-i)) for i, x in enumerate(rnd.sample(days("2026-01-01", 90), 25))]
        left += [(pair, *x) for x in a]
        right += [(pair, *x) for x in b]
        expected += [(pair, *x) for x in _greedy(a, b)]
    schema = "pair string, t date, v double"
    out = J.nearest_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "pair", "t", "v")
    assert rows(out) == sorted(expected, key=order)


def test_nearest_match_over_a_long_calendar(spark):
    """A pair of daily series never breaks; the work grows with the days, and days of one side compete."""
    start = d("1990-01-01")
    took = {}
    for n in (2_500, 10_000):
        left = [("p", start + dt.timedelta(days=i), float(i)) for i in range(n) if i % 10 != 3]
        right = [("p", start + dt.timedelta(days=i + i % 3), -float(i)) for i in range(n)]
        schema = "pair string, t date, v double"
        frames = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
        begin = time.monotonic()
        got = rows(J.nearest_match(*frames, "pair", "t", "v"))
        took[n] = time.monotonic() - begin
        if n == 2_500:
            least = {}
            for _, day, v in right:
                least[day] = min(v, least.get(day, v))
            want = _greedy([x[1:] for x in left], list(least.items()))
            assert got == sorted([("p", *x) for x in want], key=order)
    assert took[10_000] < 8 * took[2_500] + 2


def test_ratio_and_previous(spark):
    df = spark.createDataFrame(
        [("H100", d("2026-01-01"), 2.0), ("B200", d("2026-01-01"), 5.0), ("B200", d("2026-01-02"), 5.0), ("H100", d("2026-01-03"), 0.0), ("B200", d("2026-01-03"), 1.0)],
        "s string, t date, v double",
    )
    assert rows(J.ratio_to_base(df, "s", "t", "v", "H100")) == [(d("2026-01-01"), "B200", 2.5)]


def test_first_candidate_and_free(spark):
    df = spark.createDataFrame([("v/m-20250101",), ("v/x:free",), ("v/none",), ("v/bad",)], "name string")
    prices = spark.createDataFrame(
        [("v/m", "0.000001", None), ("openrouter/v/m-20250101", None, None), ("v/x", "1", "1"), ("v/bad", "oops", "1"), ("bad", "2", None)],
        "key string, i string, o string",
    )
    out = J.first_candidate_join(df, "name", prices, "key", "i", "o")
    assert rows(out) == sorted(
        [("v/m-20250101", 1.0, None, "v/m"), ("v/x:free", 0.0, 0.0, "free_variant"), ("v/none", None, None, None), ("v/bad", 2000000.0, None, "bad")],
        key=repr,
    )


def test_keys_that_share_a_bucket_with_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(O, "KEY_BUCKETS", 4)
    df = spark.range(6_000).selectExpr("IF(id % 2 = 0, NULL, id % 41) AS k", "double(pmod(hash(id), IF(id % 2 = 0, 100000, 7))) AS v")
    wanted = {"m": (0.5, "inclusive"), "a": (0.25, "exclusive"), "b": (0.75, "exclusive")}
    got = O.group_quantiles(df, ["k"], "v", wanted, {"n": "count", "s": "sum"}, small=500)
    plain = O.group_quantiles(df, ["k"], "v", wanted, {"n": "count", "s": "sum"})
    assert rows(got) == rows(plain) and got.count() == 42
    one = O.group_quantiles(df, ["k"], "v", {"m": (0.5, "inclusive")}, small=500)
    assert {r.k: r.m for r in one.collect()} == {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
