"""Exact quantiles, 256-bit numbers, interval joins and stored sets against brute force."""

import datetime as dt
import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import uint256 as U
from tokenloom.operators import bitmaps as M
from tokenloom.operators import joins as J
from tokenloom.operators import ordering as O


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


# -- quantiles ---------------------------------------------------------------


@pytest.mark.parametrize("spread", [10**6, 7])
def test_quantiles_of_a_group_that_holds_most_rows(spark, spread, monkeypatch):
    monkeypatch.setattr(O, "SMALL", 200)
    monkeypatch.setattr(O, "ACCURACY", 200)
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randrange(spread)) for _ in range(20000)]
    df = spark.createDataFrame(data + [("a", None), ("empty", None)], "k string, v bigint").repartition(9)
    wanted = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p501": 0.501, "p99": 0.99, "high": 1.0}
    got = {r.k: r for r in O.exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"hot", "a", "b", None}
    for k, r in got.items():
        values = [v for x, v in data if x == k]
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12), (k, name)
    whole = O.exact_quantile(df, [], "v", 0.25).first()[0]
    assert whole == pytest.approx(np.quantile([v for _, v in data], 0.25))


def test_quantile_keeps_a_small_part_and_sorts_no_range(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n).cast("decimal(20,3)").alias("v"))
    out = O.exact_quantile(df, ["k"], "v", 0.5)
    text = plan(out)
    assert "rangepartitioning" not in text.lower() and "Scan ExistingRDD" not in text
    assert out.first().quantile == (n - 1) / 2
    # what passes the selection: rows inside the bracket and one counted row on each side
    reach = 6 / O.ACCURACY
    kept = df.where((F.col("v") >= n * (0.5 - reach)) & (F.col("v") <= n * (0.5 + reach))).count()
    assert kept < n / 500


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert O.exact_quantile(df, ["k"], "v").count() == 0
    assert [r.quantile for r in O.exact_quantile(df, [], "v").collect()] in ([], [None])


# -- 256-bit numbers -----------------------------------------------------------


def test_uint256_round_trips_and_arithmetic(spark):
    rng = random.Random(2)
    top = 2**256 - 1
    values = [0, 1, 2**53 + 1, 2**64 - 1, 2**64, 2**128 + 5, 2**192 - 1, top, top - 1, 10**38 - 1, 10**38, 2**255] + [rng.getrandbits(rng.choice([40, 100, 256])) for _ in range(60)]
    pairs = [(hex(a), hex(b)[2:].upper(), str(a), str(b)) for a, b in zip(values, values[1:] + values[:1])]
    df = spark.createDataFrame(pairs, "a string, b string, ta string, tb string").withColumns({"x": U.from_hex("a"), "y": U.from_hex("b")})
    out = df.select(
        "ta", "tb", U.to_text("x").alias("x"), U.to_text(U.add("x", "y")).alias("sum"), U.to_text(U.subtract("x", "y")).alias("less"),
        U.to_double("x").alias("d"), U.to_decimal("x").alias("dec"), U.signed_text("x").alias("signed"), (F.col("x") < F.col("y")).alias("lt"),
    )
    for r in out.collect():
        a, b = int(r.ta), int(r.tb)
        assert r.x == r.ta
        assert r["sum"] == (str(a + b) if a + b <= top else None)
        assert r.less == (str(a - b) if a >= b else None)
        assert r.d == pytest.approx(float(a), rel=1e-15)
        assert (int(r.dec) if r.dec is not None else None) == (a if a < 10**38 else None)
        assert int(r.signed) == (a - 2**256 if a >= 2**255 else a)
        assert r.lt == (a < b)


def test_uint256_sums_carry(spark):
    rng = random.Random(3)
    data = [(k, rng.getrandbits(240)) for k in "ab" for _ in range(500)] + [("c", 2**256 - 1), ("c", 1), ("d", 2**256 - 1)]
    df = spark.createDataFrame([(k, f"{v:x}") for k, v in data], "k string, h string").select("k", U.from_hex("h").alias("v")).repartition(7)
    got = {r.k: (r.t, r.m) for r in df.groupBy("k").agg(U.total("v").alias("t"), F.max("v").alias("m")).select("k", U.to_text("t").alias("t"), U.to_text("m").alias("m")).collect()}
    for k in "abcd":
        mine = [v for x, v in data if x == k]
        assert got[k] == (str(sum(mine)) if sum(mine) < 2**256 else None, str(max(mine)))


def test_uint256_rejects_what_is_no_number(spark):
    df = spark.createDataFrame([("",), ("0x",), ("xyz",), ("1" * 65,), (None,), ("0X1f",), ("12 ",)], "h string")
    assert [r.t for r in df.select(U.to_text(U.from_hex("h")).alias("t")).collect()] == [None, None, None, None, None, "31", None]
    numbers = spark.createDataFrame([(0,), (5,), (-1,), (2**63 - 1,), (None,)], "n bigint")
    assert [r.t for r in numbers.select(U.to_text(U.from_number("n")).alias("t")).collect()] == ["0", "5", None, str(2**63 - 1), None]


# -- interval joins ------------------------------------------------------------


def test_interval_join_of_many_ranges_on_one_key(spark):
    n, span = 100_000, 40_000
    ranges = spark.range(n).select(F.lit("hot").alias("k"), "id", F.pmod(F.col("id") * 7919, F.lit(span)).alias("b"), F.pmod(F.col("id") * 31, F.lit(60)).alias("len"))
    ranges = ranges.select("k", "id", "b", (F.col("b") + F.col("len")).alias("e"))
    points = spark.range(n).select(F.lit("hot").alias("k"), F.pmod(F.col("id") * 104729, F.lit(span)).alias("p"))
    out = J.interval_join(points, ranges, ["k"], ("p", "p"), ("b", "e"), width=64)
    i = np.arange(n)
    b, e, p = i * 7919 % span, i * 7919 % span + i * 31 % 60, i * 104729 % span
    want = np.searchsorted(np.sort(b), p, side="right") - np.searchsorted(np.sort(e), p, side="left")
    assert out.count() == want.sum()
    text = plan(out)
    assert "CartesianProduct" not in text and "NestedLoopJoin Inner BuildRight" not in text.replace("BroadcastNestedLoopJoin", "")
    # per point of a hot key only one bin of ranges is compared, not all of them
    largest = ranges.select(F.explode(F.sequence(F.floor(F.col("b") / 64), F.floor(F.col("e") / 64))).alias("bin")).groupBy("bin").count().agg(F.max("count")).first()[0]
    assert largest < n / 200


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_against_all_pairs(spark, closed):
    rng = random.Random(5)

    def make(n):
        return [(rng.choice(["a", "b", None]), i, day(s) if rng.random() > 0.05 else None, day(s + rng.choice([-2, 0, 1, 9, 200]))) for i in range(n) for s in [rng.randrange(300)]]

    left, right = make(60), make(80) + [("a", 900, day(-9000), dt.date(9999, 12, 31))]
    schema = "k string, id int, b date, e date"
    out = J.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("b", "e"), ("b", "e"), width=16, closed=closed)
    got = sorted((r.id, r._r_id) for r in out.collect())

    def meets(x, y):
        if None in (x[0], x[2], y[0], y[2]) or x[0] != y[0] or x[2] > x[3] or y[2] > y[3]:
            return False
        return x[2] <= y[3] and y[2] <= x[3] if closed else x[2] < y[3] and y[2] < x[3]

    assert got == sorted((x[1], y[1]) for x in left for y in right if meets(x, y))


def test_points_are_kept_without_a_range(spark):
    facts = spark.createDataFrame([("a", day(0)), ("a", day(5)), ("b", day(5)), ("a", None), (None, day(5))], "k string, d date")
    dim = spark.createDataFrame([("a", day(3), dt.date(9999, 12, 31), "x"), ("a", day(5), day(5), "y"), ("b", day(6), day(4), "z")], "k string, s date, e date, label string")
    got = sorted(((r.k, r.d, r.label) for r in J.scd_join(facts, dim, ["k"], "d", "s", "e").collect()), key=str)
    assert got == sorted([("a", day(0), None), ("a", day(5), "x"), ("a", day(5), "y"), ("b", day(5), None), ("a", None, None), (None, day(5), None)], key=str)
    assert J.scd_join(facts.where("false"), dim, ["k"], "d", "s", "e").count() == 0
    with pytest.raises(ValueError):
        J.interval_join(dim, dim, ["k"], ("s", "e"), ("s", "e"), how="left")


def test_times_join_by_bins_of_seconds(spark):
    at = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", at + dt.timedelta(seconds=30 * i)) for i in range(100)], "k string, t timestamp")
    right = spark.createDataFrame([("a", at + dt.timedelta(seconds=61 * i), at + dt.timedelta(seconds=61 * i + 90)) for i in range(20)], "k string, s timestamp, e timestamp")
    out = J.interval_join(left, right, ["k"], ("t", "t"), ("s", "e"), width=60, closed=False)
    assert out.count() == sum(61 * j <= 30 * i < 61 * j + 90 for i in range(100) for j in range(20))


# -- stored sets -----------------------------------------------------------------


def test_sets_of_members_answer_any_union(spark):
    rng = random.Random(6)
    data = [(rng.choice("xyz"), day(rng.randrange(30)), rng.randrange(40_000) if rng.random() < 0.5 else rng.randrange(50)) for _ in range(6000)]
    df = spark.createDataFrame([(a, b, f"m{c:05d}") for a, b, c in data], "t string, day date, m string").repartition(5)
    numbers = M.number_members(df, "m").cache()
    ids = [r._id for r in numbers.collect()]
    assert sorted(ids) == list(range(len({c for _, _, c in data})))
    sets = M.bitmaps(df, ["t", "day"], "m", numbers).cache()
    assert {r.day: r.holders for r in M.count_members(sets, ["day"]).collect()} == {d: len({c for _, x, c in data if x == d}) for d in {x for _, x, _ in data}}
    assert {r.t: r.holders for r in M.count_members(sets, ["t"]).collect()} == {t: len({c for x, _, c in data if x == t}) for t in "xyz"}
    got = {(r.day, r.n): r.holders for r in M.count_by_overlap(sets, ["day"], "t", ["x", "y", "z"]).collect()}
    want = {}
    for d in {x for _, x, _ in data}:
        held = {}
        for t, x, c in data:
            if x == d:
                held.setdefault(c, set()).add(t)
        for tokens in held.values():
            want[d, len(tokens)] = want.get((d, len(tokens)), 0) + 1
    assert got == want
    with pytest.raises(ValueError):
        M.count_by_overlap(sets, ["day"], "t", [str(i) for i in range(13)])


def test_numbers_given_before_stay(spark):
    first = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "m string")
    known = M.number_members(first, "m")
    later = M.number_members(spark.createDataFrame([("c",), ("a",), ("0",)], "m string"), "m", known)
    assert sorted((r.m, r._id) for r in later.collect()) == [("0", 2), ("a", 0), ("b", 1), ("c", 3)]


def test_days_of_holding_become_bits_where_they_are_made(spark):
    holding = spark.createDataFrame([("t", "a", day(0), day(3)), ("t", "b", day(2), day(5)), ("t", "c", day(4), day(4)), ("u", "a", day(2), day(3))], "t string, m string, s date, e date")
    sets = M.interval_bitmaps(holding, ["t"], "m", "s", "e", M.number_members(holding, "m"))
    got = {(r.t, r.day): r.holders for r in M.count_members(sets, ["t", "day"]).collect()}
    assert got == {("t", day(0)): 1, ("t", day(1)): 1, ("t", day(2)): 2, ("t", day(3)): 1, ("t", day(4)): 1, ("u", day(2)): 1}
    assert {r.day: r.holders for r in M.count_members(sets, ["day"]).collect()}[day(2)] == 2
