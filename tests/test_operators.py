"""Hand-made rows: ties, gaps, NULLs, empty input, hot keys against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import scalar as B
from tokenloom.operators import cohorts as C
from tokenloom.operators import governance as G
from tokenloom.operators import joins as J
from tokenloom.operators import ledger as L
from tokenloom.operators import liquidity as Q
from tokenloom.operators import nav as N
from tokenloom.operators import ordering as O
from tokenloom.operators import promo as P
from tokenloom.operators import stats as S
from tokenloom.operators import timeseries as T


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """Events in which one key holds a third of all rows, with many equal values."""
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", i, rng.choice([1, 1, 2, 3, 5, 8]), rng.random() < 0.5) for i in range(3000)]
    return data, spark.createDataFrame(data, "key string, seq int, v int, right boolean").cache()


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(" \\xABcd", "0xAB", 5.5, "ffffffffffffffffffffffff", 0.0)], "a string, b string, n double, h string, z double")
    r = df.select(
        B.norm_address("a").alias("a"), B.norm_address("b").alias("b"), B.to_int("n").alias("n"), B.hex_to_number("h").alias("h"),
        B.safe_div("n", "z").alias("z"), B.scale(F.lit(15 * 10**17), None).alias("s"),
    ).first()
    assert (r.a, r.b, r.n, r.z, r.s) == ("0xabcd", "0xab", 6, None, 1.5)
    assert r.h == float(16**24 - 1)
    huge = df.select(B.scale(F.lit("1" + "0" * 40)).alias("x")).first().x  # beyond 38 digits: double, no overflow
    assert huge == pytest.approx(1e22)


def test_intervals_and_steps(spark):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(3), 2), ("a", day(9), 3)], "k string, day date, v int")
    out = T.expand_intervals(T.step_intervals(df, ["k"], "day", "2024-01-05"), "day", "next_day", "day")
    assert rows(out, "day", "v") == [(day(0), 1), (day(1), 1), (day(2), 1), (day(3), 2), (day(4), 2)]
    backwards = spark.createDataFrame([(day(3), day(3)), (day(4), day(2))], "a date, b date")
    assert T.expand_intervals(backwards, "a", "b", "d").count() == 0
    assert T.step_series(df.where("false"), ["k"], "day", "v", ["day"], "2024-01-05").count() == 0


def test_locf_keeps_leading_nulls_and_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None)], "k string, t int, v int")
    once = T.locf(df, ["k"], "t", ["v"])
    assert rows(once.na.fill(-1), "k", "t", "v") == [("a", 1, -1), ("a", 2, 5), ("a", 3, 5), ("b", 1, -1)]
    assert rows(T.locf(once, ["k"], "t", ["v"]).na.fill(-1), "k", "t", "v") == rows(once.na.fill(-1), "k", "t", "v")
    same = T.fill_by_group(df, ["k"], "t", "v", "f")
    assert rows(same.na.fill(-1), "k", "t", "f") == rows(once.na.fill(-1), "k", "t", "v")


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_with_hot_key(spark, hot, inclusive, monkeypatch):
    monkeypatch.setattr(J, "WIDE", 3)  # so that many wide buckets are crossed
    data, df = hot
    right = df.where("right").select("key", "seq", F.col("v").alias("w"))
    left = df.where(F.col("seq") % 2 == 0).select("key", "seq")
    out = J.asof_last(left, right, ["key"], ["seq"], ["w"], F.floor(F.col("seq") / 100), inclusive)
    want = {}
    for key, seq, _, _ in data:
        if seq % 2 == 0:
            past = [v for k, s, v, r in data if r and k == key and (s <= seq if inclusive else s < seq)]
            want[seq] = past[-1] if past else None
    assert {r.seq: r.w for r in out.collect()} == want


def test_previous_and_running_with_hot_key(spark, hot, monkeypatch):
    monkeypatch.setattr(J, "WIDE", 3)
    data, df = hot
    cut = F.floor(F.col("seq") / 100)
    prev = {r.seq: r.p for r in J.previous_row(df.select("key", "seq", "v"), ["key"], ["seq"], [("v", "p")], cut).collect()}
    run = {r.seq: r.t for r in J.running_total(df.select("key", "seq", "v"), ["key"], ["seq"], "v", "t", cut).collect()}
    last, total = {}, {}
    for key, seq, v, _ in data:
        total[key] = total.get(key, 0) + v
        assert prev[seq] == last.get(key) and run[seq] == total[key]
        last[key] = v


def test_scan_and_quantile_with_hot_key(spark, hot):
    data, df = hot
    scan = O.ordered_scan(df.select("seq", "v"), [("v", True), ("seq", False)], {"cum": "v"}, ranges=5)
    order = sorted(data, key=lambda r: (-r[2], r[1]))
    want = dict(zip((r[1] for r in order), zip(range(1, len(order) + 1), np.cumsum([r[2] for r in order]))))
    assert {r.seq: (r.position, r.cum) for r in scan.collect()} == {k: (a, int(b)) for k, (a, b) in want.items()}
    grouped = O.grouped_scan(df.select("key", "seq", "v"), ["key"], [("seq", False)], {"cum": "v"}, ranges=5)
    total, pos = {}, {}
    for r in sorted(grouped.collect(), key=lambda r: r.seq):
        total[r.key] = total.get(r.key, 0) + r.v
        pos[r.key] = pos.get(r.key, 0) + 1
        assert (r.position, r.cum) == (pos[r.key], total[r.key])
    for p in (0.5, 0.25, 0.9):
        got = {r.key: r.q for r in O.exact_quantile(df, ["key"], "v", p, "q").collect()}
        for key in got:
            assert got[key] == pytest.approx(np.quantile([r[2] for r in data if r[0] == key], p))
    assert O.exact_quantile(df.where("false"), ["key"], "v").count() == 0


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(3)
    who = [L.ZERO] + [f"0x{i:08d}" for i in range(1, 9)]
    data = []
    for i in range(400):
        a, b = rng.choice(who), rng.choice(who if rng.random() > 0.3 else who[1:2])
        data.append((rng.choice(["T", "U"]), day(rng.randrange(20)), i, f"x{i // 3}", a, b, rng.randrange(1, 50)))
    return spark.createDataFrame(data, "token string, day date, ts int, tx_hash string, from_addr string, to_addr string, value int").cache()


def test_ledger_properties(spark, ledger):
    signed = L.signed_ledger(ledger)
    assert signed.agg(F.sum("amount")).first()[0] == 0
    change = L.daily_change(signed)
    a, b = L.balance_daily(change, "2024-01-25"), L.balance_daily_dense(change, "2024-01-25")
    assert rows(a, "token", "holder", "day", "balance") == rows(b, "token", "holder", "day", "balance")
    last = {(r.token, r.holder): r.balance for r in L.balance_latest(change).collect()}
    on_last_day = {(r.token, r.holder): r.balance for r in a.where("day = '2024-01-25'").collect()}
    assert last == on_last_day
    n = {(r.token, r.day): r.holders for r in L.holder_count(change, "2024-01-01", "2024-01-25").collect()}
    brute = {(r.token, r.day): r.c for r in a.where("balance > 0").groupBy("token", "day").agg(F.count("*").alias("c")).collect()}
    assert {k: v for k, v in n.items() if v} == brute
    by_n = {(r.day, r.products): r.holders for r in L.multi_product_holders(change, "2024-01-01", "2024-01-25").collect()}
    per = a.where("balance > 0").groupBy("day", "holder").agg(F.count("*").alias("p")).groupBy("day", "p").agg(F.count("*").alias("c"))
    assert by_n == {(r.day, r.p): r.c for r in per.collect()}


def test_cohort_curves_match_the_grid(spark, ledger):
    moves = L.signed_ledger(ledger, ["ts", "tx_hash"]).where(F.col("holder") != L.ZERO)
    base = C.user_base(moves, "2024-01-25", frac=0.75, drop_bots=False).cache()
    iv = C.exposure_intervals(moves, "2024-01-25", 0.75, drop_bots=False)
    got = {(r.token, r.cohort, r.day): r.retention for r in C.retention(iv).collect()}
    want = {(r.token, r.cohort, r.day): r.x for r in base.groupBy("token", "cohort", "day").agg(F.avg("retained").alias("x")).collect()}
    assert got == pytest.approx(want)
    units = {(r.token, r.cohort, r.dt): r.units for r in C.aum_by(iv, spark.createDataFrame([], "symbol string, day date, price double"), "cohort").collect()}
    want = base.where("retained = 1").groupBy("token", "cohort", "dt").agg(F.sum("running_amount").alias("u"))
    assert units == {(r.token, r.cohort, r.dt): r.u for r in want.collect()}


def test_bots_are_dropped_alike(spark, ledger):
    moves = L.signed_ledger(ledger, ["ts", "tx_hash"]).where(F.col("holder") != L.ZERO)
    a = rows(C.cohorts(C.without_bots(moves)), "token", "holder", "start_dt", "exposure")
    assert a == rows(C.cohorts(moves, drop_bots=True), "token", "holder", "start_dt", "exposure")


def test_capped_outflow_never_exceeds_what_was_bought(spark):
    bought = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "holder string, bought double")
    outs = spark.createDataFrame([("a", day(1), 4.0), ("a", day(2), 9.0), ("a", day(3), 2.0), ("b", day(2), 1.0)], "holder string, day date, amount double")
    out = P.capped_outflow_daily(bought, outs)
    assert rows(out, "day", "charged", "cum_charged") == [(day(1), 4, 4), (day(2), 7, 11), (day(3), 0, 11)]
    assert out.agg(F.min("retention_rate")).first()[0] == pytest.approx(4 / 15)


def test_rebalance_worked_example(spark):
    pools = spark.createDataFrame([("p", 1, 1000.0, 2 / 3, None), ("p", 2, 2000.0, 1 / 3, 0.25)], "pool string, idx int, balance double, weight double, spot double")
    got = {r.idx: r.new_balance for r in N.rebalance(pools).collect()}
    assert got == pytest.approx({1: 1000.0, 2: 2000.0})


def test_concentration_measures(spark):
    equal = spark.createDataFrame([(f"0x{i}", 5) for i in range(10)], "address string, balance int")
    assert G.gini(equal, "balance", "address").first().gini == pytest.approx(0.0)
    skewed = spark.createDataFrame([("0xa", 100), ("0xb", 1), ("0xc", 1)], "address string, balance int")
    none = spark.createDataFrame([], "address string")
    ranked = G.rank_wallets(skewed, none)
    assert G.nakamoto(ranked).first().nakamoto == 1
    assert max(r.cum_share for r in ranked.collect()) == pytest.approx(1.0)
    assert 0 < G.gini(skewed, "balance", "address").first().gini < 1


def test_price_below_inside_above_range(spark):
    ch = spark.createDataFrame([("a", "p", day(0), 100, -600, 600)], "address string, pool string, day date, amount int, tick_lower int, tick_upper int")
    px = spark.createDataFrame([("p", day(0), 0.5), ("p", day(1), 1.0), ("p", day(2), 2.0)], "pool string, day date, price double")
    out = {r.day: r for r in Q.lp_exposure_v3(ch, px, "2024-01-03").collect()}
    assert [out[day(i)].in_range for i in range(3)] == ["below", "between", "above"]
    assert out[day(0)].amount1 == 0 and out[day(2)].amount0 == 0 and out[day(1)].amount0 == pytest.approx(out[day(1)].amount1)


def tail_by_fraction(t, dof):
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta."""
    if t == 0:
        return 1.0
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            f *= c * d
    return 1 - front * f if swap else front * f


def test_bootstrap_weights_follow_the_poisson_law(spark):
    w = spark.range(400).select(F.explode(F.sequence(F.lit(1), F.lit(500))).alias("rep"), "id").select("rep", S.poisson_weight(F.col("id"), F.col("rep"), 3).alias("w"))
    got = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert (got.m, got.v, got.z) == (pytest.approx(1, abs=0.01), pytest.approx(1, abs=0.02), pytest.approx(math.exp(-1), abs=0.005))
    means = w.groupBy("rep").agg(F.avg("w").alias("m")).agg(F.stddev("m").alias("s")).first().s
    assert means == pytest.approx(1 / 20, rel=0.15)  # replicates are not alike


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = 2 * x + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    r = S.linreg(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    points = [(2.0, 10.0), (0.5, 3.0), (0.0, 7.0), (1.0, 1.0), (-12.706204736, 1.0), (3.0, 2400.0), (20.0, 2400.0), (40.0, 3.0)]
    tails = spark.createDataFrame(points, "t double, dof double").select("t", "dof", S.log_two_sided_p(F.col("t"), F.col("dof")).alias("lp")).collect()
    for r in tails:
        assert r.lp == pytest.approx(math.log(tail_by_fraction(abs(r.t), r.dof)), rel=1e-7, abs=1e-9), (r.t, r.dof)
    exact = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(9)], "x double, y double")
    assert S.linreg(exact, "x", "y").first().p_value == pytest.approx(0.0, abs=1e-12)
    assert S.linreg(exact.limit(2), "x", "y").first().n == 2
    one = S.bootstrap_ci(df, "i", "x", n_boot=500).first()
    two = S.bootstrap_ci(df.repartition(7), "i", "x", n_boot=500).first()
    assert one.ci_low == pytest.approx(two.ci_low) and one.ci_low < one["std"] < one.ci_high
    ties = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (3.0, 5.0)], "x double, y double")
    assert S.spearman(ties, "x", "y").first().rho == pytest.approx(0.8333333333)


def test_basket_value_carries_prices(spark):
    comp = spark.createDataFrame([(day(1), "A", 2.0), (day(1), "B", 1.0), (day(6), "A", 3.0)], "day date, component string, units double")
    prices = spark.createDataFrame([("A", day(0), 5.0), ("B", day(2), 10.0), ("A", day(4), 6.0), ("C", day(2), 99.0)], "component string, day date, price double")
    got = {r.day: r.nav for r in N.basket_nav(comp, prices, "day", str(day(8))).collect()}
    # B was in no later mint, so it leaves after the first; A keeps its price on days without a trade
    assert got == {day(1): 10.0, day(2): 10.0, day(3): 10.0, day(4): 12.0, day(5): 12.0, day(6): 18.0, day(7): 18.0, day(8): 18.0}


def test_holding_time_ends_at_an_empty_balance(spark):
    moves = [("sold", 0, 5), ("sold", 40, -5), ("kept", 0, 5), ("kept", 10, 0), ("in-out", 3, 0), ("left", 0, 2), ("left", 5, -2), ("left", 70, 0)]
    daily = spark.createDataFrame([(h, day(n), c) for h, n, c in moves], "holder string, day date, change int")
    got = {r.seq: r.users for r in C.holding_times(daily, str(day(100))).collect()}
    assert got == {2: 1, 4: 1, 1: 2}


def test_packed_order_keys_hold_every_value(spark):
    rows = [("a", -1, 5), ("a", -1, -(2**31)), ("a", 2**62, 2**31 - 1), ("a", 2**62, -7), ("b", -5, -3), ("b", -5, -2)]
    for kind in ("int", "bigint"):
        df = spark.createDataFrame([(k, x, y) for k, x, y in rows], f"k string, x bigint, y {kind}").withColumn("v", F.concat_ws("/", "x", "y"))
        got = {r.k: r.v for r in T.closing(df, ["k"], ["v"], ["x", "y"]).collect()}
        assert got == {"a": f"{2**62}/{2**31 - 1}", "b": "-5/-2"}


def test_keys_are_never_cut(spark):
    from tokenloom.functions.scalar import hex_to_number, norm_address, sort_key
    from tokenloom.sources.canonical import addr

    ids = [14_999_999, 149_999_999, 150_000_005, 7]
    got = [r.a for r in spark.createDataFrame([(i,) for i in ids], "i long").select(addr("i").alias("a")).collect()]
    assert got == ["0x15000000", "0x150000000", "0x150000006", "0x00000008"]
    pairs = [(1, 123), (1, 1234), (1, 1239), (2, 5), (10**13, 1), (10**12, 10**7)]
    df = spark.createDataFrame(pairs, "b long, i long")
    assert [(r.b, r.i) for r in df.orderBy(sort_key("b", "i")).collect()] == sorted(pairs)
    assert len({r.k for r in df.select(sort_key("b", "i").alias("k")).collect()}) == len(pairs)
    texts = spark.createDataFrame([("\\x" + "ab" * 30,), ("f" * 65,), ("ff",)], "t string").select(norm_address("t").alias("n"), hex_to_number("t").alias("h")).collect()
    assert texts[0].n == "0x" + "ab" * 30 and texts[1].h is None and texts[2].h == 255.0
