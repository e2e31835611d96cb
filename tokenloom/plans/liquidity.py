"""Liquidity, basket value and lending reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import bucket, safe_div, sqrt_price
from ..functions.windows import running_sum
from ..operators import bitmaps as M
from ..operators import issuance as I
from ..operators import ledger as L
from ..operators import lending as D
from ..operators import liquidity as Q
from ..operators import nav as N
from ..operators import prices as P
from ..operators.timeseries import closing, trend
from ..session import scratch_path
from ..sources.canonical import EVENTS_AS_OF, EVENTS_START, ORDERS_AS_OF, Tables, ratio4
from ..sources.seeds import products
from .issuance import _trend_sql, vwap_hours
from .registry import _ratio4, define_view, report, rnd, sql

AS_OF_X = "date '2024-02-01'"  # first day after the last one of the events family

# pool changes: purchases add, errors remove; k + 1 is the base side
define_view("lpc", "ev", """
    select *, case event_type when 'purchase' then 1 else -1 end as sgn, cast(60 * (k % 20 - 10) as integer) as tick_lower,
           cast(60 * (k % 20 - 10) + 60 * (1 + k % 7) as integer) as tick_upper
    from ev where event_type in ('purchase', 'error')""")
define_view("v2px", "swaps event_days", f"""
    select pool, e.day, price from (
      select *, lead(day, 1, {AS_OF_X}) over (partition by pool order by day) as nxt from (
        select pool, day, arg_max(cast(amount1 + 1 as double) / cast(amount0 as double), event_id) as price from swaps group by all)) p
    join event_days e on e.day >= p.day and e.day < p.nxt""")
define_view("lp_pos", "signed", """
    with s as (select token, holder, sum(amount) as amount from signed
               where day < date '2024-01-03' and (token = 'P2' or (token = 'P1' and holder = '0x00000005')) group by all)
    select holder, cast(amount as double) / cast((select -sum(amount) from s where token = 'P2' and holder = '0x00000000') as double)
                   * cast((select sum(amount) from s where token = 'P1' and holder = '0x00000005') as double) as position
    from s where token = 'P2' and holder <> '0x00000000' and amount > 0.01""")
define_view("v3px", "swaps", """
    select *, sqrt(1 + (amount1 - 50) / 1000.0::double) * 79228162514264337593543950336.0::double as sqrt_x96 from swaps""")
define_view("v3exp", "lpc v3px event_days", f"""
    select c.address, c.pool, tick_lower, tick_upper, e.day, amount, price from (
      select *, lead(day, 1, {AS_OF_X}) over w as nxt, sum(d) over w as amount from (
        select address, pool, tick_lower, tick_upper, day, sum(sgn * value) as d from lpc group by all)
      window w as (partition by address, pool, tick_lower, tick_upper order by day)) c
    join event_days e on e.day >= c.day and e.day < c.nxt
    join (select q.pool, h.day, q.price from (
            select *, lead(day, 1, {AS_OF_X}) over (partition by pool order by day) as nxt from (
              select pool, day, arg_max(sqrt_x96 * sqrt_x96 / 6277101735386680763835789423207666416102355444464034512896.0::double, event_id) as price
              from v3px group by all)) q
          join event_days h on h.day >= q.day and h.day < q.nxt) p on p.pool = c.pool and p.day = e.day
    where amount > 0""")
define_view("v2exp", "lpc v2px event_days", f"""
    select c.address, c.pool, e.day, price, sqrt(cast(amount as double) / price) as amount0, sqrt(cast(amount as double) * price) as amount1 from (
      select *, lead(day, 1, {AS_OF_X}) over w as nxt, sum(d) over w as amount from (
        select address, pool, day, sum(sgn * value * (k + 1)) as d from lpc group by all) window w as (partition by address, pool order by day)) c
    join event_days e on e.day >= c.day and e.day < c.nxt join v2px p on p.pool = c.pool and p.day = e.day
    where amount > 0""")
define_view("lend", "ev event_days", f"""
    select address, e.day, x as exposure from (
      select *, lead(day, 1, {AS_OF_X}) over (partition by address order by day) as nxt, sum(c) over (partition by address order by day) as x from (
        select address, day, sum(case event_type when 'signup' then value else -value end) as c from ev where event_type in ('signup', 'click') group by all)) s
    join event_days e on e.day >= s.day and e.day < s.nxt""")
define_view("expo", "daily_bal v2exp v3exp lend", """
    select address, day, sum(x) as exposure from (
      select holder as address, day, cast(sum(balance) as double) as x from daily_bal group by all union all select address, day, amount0 from v2exp
      union all select address, day, a0 from (
        select *, case when price < pl then amount / sqrt(pl) - amount / sqrt(pu) when price > pu then 0 else amount / sqrt(price) - amount / sqrt(pu) end as a0
        from (select *, power(1.0001::double, tick_lower) as pl, power(1.0001::double, tick_upper) as pu from v3exp))
      union all select address, day, cast(exposure as double) from lend) group by all""")


def lp_events(t: Tables):
    sign = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    lower = 60 * (F.pmod("k", F.lit(20)) - 10)
    return t.of_type("purchase", "error").withColumns({
        "sgn": sign, "tick_lower": lower.cast("int"), "tick_upper": (lower + 60 * (1 + F.pmod("k", F.lit(7)))).cast("int"),
    })


def v2_changes(t: Tables):
    return lp_events(t).select("address", "pool", "day", (F.col("sgn") * F.col("value") * (F.col("k") + 1)).alias("amount"))


def v3_changes(t: Tables):
    return lp_events(t).select("address", "pool", "tick_lower", "tick_upper", "day", (F.col("sgn") * F.col("value")).alias("amount"))


def v2_prices(t: Tables):
    view = F.col("event_type") == "view"
    s = t.swaps.withColumns({
        "in0": F.when(view, F.col("amount0")).otherwise(F.lit(0)), "out0": F.when(view, F.lit(0)).otherwise(F.col("amount0")),
        "in1": F.when(view, F.lit(0)).otherwise(F.col("amount1") + 1), "out1": F.when(view, F.col("amount1") + 1).otherwise(F.lit(0)),
    })
    px = s.select("pool", "day", "event_id", Q.v2_swap_price("in0", "out0", "in1", "out1").alias("price"))
    return Q.closing_prices(px, ["event_id"], EVENTS_AS_OF)


def v3_swaps(t: Tables):
    sq = F.sqrt(F.lit(1) + (F.col("amount1") - 50) / F.lit(1000.0)) * F.lit(2.0**96)
    return t.swaps.withColumn("sqrt_x96", sq)


def v3_prices(t: Tables):
    return Q.closing_prices(v3_swaps(t).withColumn("price", sqrt_price("sqrt_x96")), ["event_id"], EVENTS_AS_OF)


def v2_exposure(t: Tables):
    return Q.lp_exposure_v2(v2_changes(t), v2_prices(t), EVENTS_AS_OF)


def v3_exposure(t: Tables):
    return Q.lp_exposure_v3(v3_changes(t), v3_prices(t), EVENTS_AS_OF)


def lending_changes(t: Tables):
    signed = F.when(F.col("event_type") == "signup", F.col("value")).otherwise(-F.col("value"))
    return t.of_type("signup", "click").select("address", "day", signed.alias("amount"))


def exposure(t: Tables):
    wallet = L.balance_daily(L.daily_change(L.signed_ledger(t.transfers)), EVENTS_AS_OF)
    # wallet rows are added over tokens exactly before they meet the double columns
    wallet = wallet.groupBy(F.col("holder").alias("address"), "day").agg(F.sum("balance").cast("double").alias("exposure"))
    pools = [df.select("address", "day", F.col("amount0").alias("exposure")) for df in (v2_exposure(t), v3_exposure(t))]
    lend = Q.lending_exposure(lending_changes(t), EVENTS_AS_OF).select("address", "day", F.col("exposure").cast("double").alias("exposure"))
    return Q.total_exposure([wallet, *pools, lend])


@report("l01_pools_for", sql("", """
    , f as (select distinct p_brand || '/' || p_type as pool, p_brand as token0, p_type as token1 from part),
    k as (select p_brand as address, upper(p_brand) as symbol, 18 as decimals from part union select p_type, upper(p_type), 6 from part)
    select f.pool, token0, token1, a.symbol as symbol0, cast(a.decimals as bigint) as decimals0, b.symbol as symbol1, cast(b.decimals as bigint) as decimals1
    from f join k a on a.address = token0 join k b on b.address = token1 where token0 in ('Brand#1', 'Brand#2') or token1 = 'PROMO'"""))
def _(t):
    part = t.raw("part")
    factory = part.select(F.concat_ws("/", "p_brand", "p_type").alias("pool"), F.col("p_brand").alias("token0"), F.col("p_type").alias("token1")).distinct()
    tokens = part.select(F.col("p_brand").alias("address"), F.lit(18).alias("decimals")).union(part.select("p_type", F.lit(6))).distinct()
    return Q.pools_for(factory, tokens.withColumn("symbol", F.upper("address")), ["Brand#1", "Brand#2", "PROMO"])


@report("l02_lp_exposure_v2", sql("v2exp", "select * from v2exp"))
def _(t):
    return v2_exposure(t)


@report("l03_lp_exposure_v3", sql("v3exp", """
    select address, pool, tick_lower, tick_upper, day, price,
           case when price < pl then 'below' when price > pu then 'above' else 'between' end as in_range,
           round(case when price < pl then amount / sqrt(pl) - amount / sqrt(pu) when price > pu then 0 else amount / sqrt(price) - amount / sqrt(pu) end, 9) as amount0,
           round(case when price < pl then 0 when price > pu then amount * sqrt(pu) - amount * sqrt(pl) else amount * sqrt(price) - amount * sqrt(pl) end, 9) as amount1
    from (select * exclude (amount), cast(amount as double) as amount, power(1.0001::double, tick_lower) as pl, power(1.0001::double, tick_upper) as pu from v3exp)"""))
def _(t):
    return rnd(v3_exposure(t), 9, "amount0", "amount1")


@report("l04_lp_share", sql("lp_pos", "select * from lp_pos"))
def _(t):
    return Q.lp_share(t.transfers, "P2", "P1", "0x00000005", before="2024-01-03")


@report("h01_lp_positions_latest", sql("signed", """,
    s as (select token, holder, sum(amount) as amount from signed where token = 'P2' or (token = 'P1' and holder = '0x00000005') group by all)
    select holder, cast(amount as double) / cast((select -sum(amount) from s where token = 'P2' and holder = '0x00000000') as double)
                   * cast((select sum(amount) from s where token = 'P1' and holder = '0x00000005') as double) as position
    from s where token = 'P2' and holder <> '0x00000000' and amount > 0.01"""))
def _(t):
    return Q.lp_share(t.transfers, "P2", "P1", "0x00000005")


@report("l05_lending_exposure", sql("lend", "select address, day, cast(exposure as double) as exposure from lend"))
def _(t):
    return Q.lending_exposure(lending_changes(t), EVENTS_AS_OF)


@report("l06_total_exposure", sql("expo", "select address, day, round(exposure, 6) as exposure from expo"))
def _(t):
    return rnd(exposure(t), 6, "exposure")


@report("l06_exposed_holders", sql("expo", "select day, count(*) as holders from expo where exposure > 0 group by day"))
def _(t):
    return Q.exposed_holders(exposure(t))


def exposed_sets(t: Tables):
    """Stored sets of exposed addresses per day."""
    numbers, sets = scratch_path(t.spark, "exposed-numbers"), scratch_path(t.spark, "exposed-sets")
    held = exposure(t).where("exposure > 0").select("day", "address")
    M.number_members(held, "address").write.parquet(numbers)
    M.bitmaps(held, ["day"], "address", t.spark.read.parquet(numbers)).write.parquet(sets)
    return t.spark.read.parquet(sets)


@report("l06_exposed_holders_stored", sql("expo", "select day, count(*) as holders from expo where exposure > 0 group by day"))
def _(t):
    return M.count_members(exposed_sets(t), ["day"])


@report("l06_exposed_holders_weekly", sql("expo", "select cast(date_trunc('week', day) as date) as week, count(distinct address) as holders from expo where exposure > 0 group by 1"))
def _(t):
    return M.count_members(exposed_sets(t), [F.to_date(F.date_trunc("week", "day")).alias("week")])


@report("l07_lp_wallet_summary", sql("v2exp v3exp latest_bal", """,
    p as (select address as holder, sum(amount0) filter (where day = date '2024-01-30') as v2_lp from v2exp group by 1),
    q as (select address as holder, 0.0 + sum(cast(amount as double)) filter (where day = date '2024-01-30') as v3_lp from v3exp group by 1),
    h as (select coalesce(p.holder, q.holder) as holder, coalesce(v2_lp, 0) as v2_lp, coalesce(v3_lp, 0) as v3_lp
          from p full join q on p.holder = q.holder where v2_lp is not null or v3_lp is not null)
    select h.holder, round(coalesce(w, 0) + v2_lp + v3_lp, 6) as balance, coalesce(w, 0) as in_wallet, round(v2_lp + v3_lp, 6) as in_pools,
           round(v2_lp, 6) as v2_lp, round(v3_lp, 6) as v3_lp
    from h left join (select holder, cast(round(cast(balance as double)) as bigint) as w from latest_bal where token = 'P0') b on b.holder = h.holder"""))
def _(t):
    on = F.col("day") == F.lit("2024-01-30").cast("date")
    v2 = v2_exposure(t).where(on).select(F.col("address").alias("holder"), F.lit("v2_lp").alias("kind"), F.col("amount0").alias("position"))
    keys = ["address", "pool", "tick_lower", "tick_upper"]
    open3 = L.expand_intervals(Q.position_intervals(v3_changes(t), keys, EVENTS_AS_OF), "day", "next_day", "day").where(on)
    open3 = open3.join(v3_prices(t).select("pool", "day"), ["pool", "day"], "left_semi")
    v3 = open3.select(F.col("address").alias("holder"), F.lit("v3_lp").alias("kind"), F.col("amount").cast("double").alias("position"))
    wallet = L.balance_latest(L.daily_change(L.signed_ledger(t.transfers))).where("token = 'P0'")
    return rnd(Q.lp_wallet_summary(v2.union(v3), ["v2_lp", "v3_lp"], wallet), 6, "balance", "in_pools", "v2_lp", "v3_lp")


define_view("pool_dim", "products", "select symbol as pool, base as token0, case when base = 'B0' then 'B1' else 'B0' end as token1, venue from products")
define_view("hour_px", "base_minutes", """
    select symbol, date_trunc('hour', minute) as hour, cast(sum(price) as double) / count(price) as price from base_minutes group by all""")
define_view("res2", "ev pool_dim hour_px", """
    select s.pool, s.day, avg(s.r0) as reserve0, avg(s.r1) as reserve1, avg(s.r0 * a.price + s.r1 * b.price) as reserves_usd
    from (select *, date_trunc('hour', ts) as hour, cast(value as double) as r0, cast(k as double) as r1 from ev where event_type = 'click') s
    join pool_dim p on p.pool = s.pool join hour_px a on a.symbol = p.token0 and a.hour = s.hour join hour_px b on b.symbol = p.token1 and b.hour = s.hour
    group by all""")
define_view("res3", "lpc swaps pool_dim hour_px", """
    select x.pool, day, avg(r0 * a.price + r1 * b.price) as reserves_usd from (
      select *, cast(sum(a0) over w as double) as r0, cast(sum(a1) over w as double) as r1, date_trunc('hour', ts) as hour from (
        select pool, ts, day, sum(a0) as a0, sum(a1) as a1 from (
          select pool, ts, day, sgn * value as a0, sgn * (k + 1) as a1 from lpc
          union all select pool, ts, day, case event_type when 'view' then amount0 else -amount0 end, case event_type when 'view' then -amount1 else amount1 end from swaps)
        group by all) window w as (partition by pool order by ts)) x
    join pool_dim p on p.pool = x.pool left join hour_px a on a.symbol = p.token0 and a.hour = x.hour left join hour_px b on b.symbol = p.token1 and b.hour = x.hour
    group by all""")


def pool_dim(t: Tables):
    other = F.when(F.col("base") == "B0", F.lit("B1")).otherwise(F.lit("B0"))
    return F.broadcast(products(t.spark).select(F.col("symbol").alias("pool"), F.col("base").alias("token0"), other.alias("token1"), "venue"))


def hour_prices(t: Tables):
    return P.hourly_base(t.base_minutes, ["symbol"]).withColumnRenamed("base_price", "price")


def sync(t: Tables):
    return t.of_type("click").select(
        "pool", "day", "block", "idx", "tx_hash", F.date_trunc("hour", "ts").alias("hour"), F.col("value").alias("reserve0"), F.col("k").alias("reserve1")
    )


def reserves2(t: Tables):
    return Q.reserves_v2(sync(t), pool_dim(t), hour_prices(t), "hour")


def reserves3(t: Tables):
    hour = F.date_trunc("hour", "ts").alias("hour")
    lp = lp_events(t).select("pool", "ts", "day", hour, (F.col("sgn") * F.col("value")).alias("amount0"), (F.col("sgn") * (F.col("k") + 1)).alias("amount1"))
    way = F.when(F.col("event_type") == "view", 1).otherwise(-1)
    sw = t.swaps.select("pool", "ts", "day", "hour", (way * F.col("amount0")).alias("amount0"), (-way * F.col("amount1")).alias("amount1"))
    return Q.reserves_v3([lp, sw], pool_dim(t), hour_prices(t), "hour")


@report("l08_reserves_v2", sql("res2", "select pool, day, round(reserve0, 6) as reserve0, round(reserve1, 6) as reserve1, round(reserves_usd, 4) as reserves_usd from res2"))
def _(t):
    return rnd(rnd(reserves2(t), 6, "reserve0", "reserve1"), 4, "reserves_usd")


@report("l09_reserves_v3", sql("res3", "select pool, day, round(reserves_usd, 3) as reserves_usd from res3"))
def _(t):
    return rnd(reserves3(t), 3, "reserves_usd")


@report("l10_reserves_compare", sql("res2 res3", """
    select pool, day, round(reserves_usd, 3) as reserves_usd, 'v3' as version from res3
    union all select pool, day, round(reserves_usd, 3), 'v2' from res2"""))
def _(t):
    return rnd(Q.reserves_compare(reserves2(t), reserves3(t)), 3, "reserves_usd")


def _band(pct: int) -> str:
    f = f"{1 + pct / 100}::double"
    return f"""sum(case when tick between x and ln(1.0::double / (price * (1 / {f}))) / l then a end) as minus_{pct},
               sum(case when tick between ln(1.0::double / (price * {f})) / l and x then a end) as plus_{pct}"""


define_view("bands", "lpc v3px", f"""
    with c as (select pool, tick_lower, tick_upper, time_bucket(interval 4 hours, ts, timestamp '1970-01-01') as bucket, sum(sgn * value) as c from lpc group by all),
    px as (select pool, time_bucket(interval 4 hours, ts, timestamp '1970-01-01') as bucket, arg_max(1 + (amount1 - 50) / 1000.0::double, event_id) as price from v3px group by all),
    r as (select *, sum(c) over w as amount, lead(bucket) over w as nxt from c window w as (partition by pool, tick_lower, tick_upper order by bucket)),
    o as (select r.pool, px.bucket, price, unnest(generate_series(tick_lower, tick_upper, 60)) as tick, cast(amount as double) as a
          from r join px on px.pool = r.pool and px.bucket >= r.bucket and (nxt is null or px.bucket < nxt) where amount > 0),
    y as (select *, ln(1.0::double / price) / l as x from (select *, ln(1.0001::double) as l from o))
    select pool, bucket, price, sum(case when tick > x then a else 0 end) as below_price, sum(case when tick < x then a else 0 end) as above_price,
           {", ".join(_band(p) for p in (2, 5, 10))}
    from y group by all""")
BANDS = [f"{s}_{p}" for p in (2, 5, 10) for s in ("minus", "plus")]


@report("l11_liquidity_bands", sql("bands", f"""
    select pool, bucket, price, round(below_price, 4) as below_price, round(above_price, 4) as above_price, round(above_price + below_price, 4) as total,
           {", ".join(f"round(coalesce({b}, 0), 4) as {b}" for b in BANDS)},
           {", ".join(f"round(coalesce(minus_{p}, 0) + coalesce(plus_{p}, 0), 4) as within_{p}, round((coalesce(minus_{p}, 0) + coalesce(plus_{p}, 0)) / nullif(above_price + below_price, 0), 9) as share_{p}" for p in (2, 5, 10))}
    from bands"""))
def _(t):
    four = bucket("ts", 4 * 3600)
    ch = lp_events(t).select("pool", "tick_lower", "tick_upper", four.alias("bucket"), (F.col("sgn") * F.col("value")).alias("amount"))
    px = v3_swaps(t).select("pool", four.alias("bucket"), "event_id", (F.lit(1) + (F.col("amount1") - 50) / F.lit(1000.0)).alias("price"))
    out = Q.liquidity_bands(ch, closing(px, ["pool", "bucket"], ["price"], ["event_id"]), 60, 4 * 3600)
    return rnd(rnd(out, 4, "below_price", "above_price", "total", *BANDS, *[f"within_{p}" for p in (2, 5, 10)]), 9, *[f"share_{p}" for p in (2, 5, 10)])


@report("l12_price_impact_v2", sql("ev", """,
    s as (select pool, ts, tx_hash, block, idx, cast(value as double) as a0, cast(k as double) as a1, event_id from ev where event_type = 'view'),
    y as (select pool, tx_hash, event_id, cast(value as double) as r0, cast(k as double) as r1 from ev where event_type = 'click'),
    j as (select s.*, y.r0, y.r1 from s join y on y.pool = s.pool and y.tx_hash = s.tx_hash and y.event_id < s.event_id
          qualify row_number() over (partition by s.event_id order by y.event_id desc) = 1),
    p as (select pool, ts, a1 as size, a1 / a0 as paid, (r1 + a1) / nullif(r0 - a0, 0) as before from j where a1 > 20 and a0 > 0)
    select pool, ts, 'v2' as version, size, round(abs((paid - before) / nullif(before, 0) * 100), 6) as price_impact from p"""))
def _(t):
    zero = F.lit(0)
    sw = t.of_type("view").select(
        "pool", "ts", "tx_hash", "block", "idx", F.col("value").alias("amount0_in"), zero.alias("amount0_out"), zero.alias("amount1_in"), F.col("k").alias("amount1_out")
    )
    return rnd(Q.price_impact_v2(sw, sync(t), 20), 6, "price_impact")


@report("l13_price_impact_v3", sql("v3px", """,
    b as (select pool, ts, event_id, cast(amount1 as double) as size, cast(amount1 as double) / nullif(cast(amount0 as double), 0) as paid,
                 sqrt_x96 * sqrt_x96 / 6277101735386680763835789423207666416102355444464034512896.0::double as after from v3px where amount1 > 20),
    c as (select *, lag(after) over (partition by pool order by event_id) as before from b)
    select pool, ts, 'v3' as version, size, abs((paid - before) / nullif(before, 0) * 100) as price_impact from c"""))
def _(t):
    return Q.price_impact_v3(v3_swaps(t), 20)


@report("l14_token_liquidity", sql("ev pool_dim event_prices", """,
    r as (select pool, day, cast(sum(value) as double) / count(*) as reserve0, cast(sum(k) as double) / count(*) as reserve1 from ev where event_type = 'click' group by all),
    j as (select r.day, venue, 'P0' as t0, p.token1 as t1, reserve0, reserve1, cast(a.price as double) as p0
          from r join pool_dim p on p.pool = r.pool left join event_prices a on a.symbol = 'P0' and a.day = r.day),
    s as (select day, venue, t0 as token, reserve0 * p0 * 2 as usd from j union all select day, venue, t1, reserve0 * p0 * 2 from j)
    select day, venue, token, round(sum(usd), 6) as liquidity from s group by all"""))
def _(t):
    res = t.of_type("click").groupBy("pool", "day").agg(P.mean("value").alias("reserve0"), P.mean("k").alias("reserve1"))
    return rnd(Q.token_liquidity(res, pool_dim(t).withColumn("token0", F.lit("P0")), t.event_prices), 6, "liquidity")


STAKERS = ["0x00000005", "0x00000009", "0x00000011"]
IN_STAKERS = "('0x00000005', '0x00000009', '0x00000011')"
define_view("stake", "signed event_days", f"""
    select e.day, sum(coalesce(m, 0)) over (order by e.day) as minted, sum(coalesce(s, 0)) over (order by e.day) as staked
    from event_days e left join (select day, -sum(amount) filter (where holder = '0x00000000') as m, sum(amount) filter (where holder in {IN_STAKERS}) as s
                                 from signed where token = 'P2' group by day) x on x.day = e.day""")


@report("l16_staked_share", sql("stake", """
    select day, cast(minted as double) as minted, cast(staked as double) as staked,
           coalesce(cast(staked as double) / nullif(cast(minted as double), 0), 0) as share from stake"""))
def _(t):
    return Q.staked_share(t.transfers, "P2", STAKERS, EVENTS_START, EVENTS_AS_OF)


define_view("brk", "ev_issuance ev stake event_prices event_days", """
    with u as (select s.symbol, e.day, sum(coalesce(a, 0)) over (partition by s.symbol order by e.day) as units
               from (select distinct symbol from ev_issuance) s cross join event_days e
               left join (select symbol, day, sum(case evt_type when 'Issue' then amount else -amount end) as a from ev_issuance group by all) x
                 on x.symbol = s.symbol and x.day = e.day),
    l as (select pool as symbol, day, cast(sum(value) as double) / count(*) as r from ev where event_type = 'click' group by all),
    o as (select pool as symbol, day, cast(sum(value) as double) / count(*) as r from ev where event_type = 'view' group by all),
    w as (select symbol, day, cast(sum(a) over v as double) / count(a) over v as avg_rewarded from (
            select pool as symbol, day, sum(value) as a from ev where event_type = 'signup' group by all) window v as (partition by symbol order by day rows 7 preceding))
    select u.symbol, u.day, cast(units as double) as total, o.r * share as incentivized, cast(units as double) - o.r * share as unincentivized, l.r as liquidity,
           o.r as optional_liquidity, share, coalesce(avg_rewarded, 0) as avg_rewarded, cast(units as double) * p as tvl, o.r * share * p as itvl,
           (cast(units as double) - o.r * share) * p as utvl, l.r * p as liquidity_value, p as price
    from u left join l on l.symbol = u.symbol and l.day = u.day left join o on o.symbol = u.symbol and o.day = u.day
    left join (select day, coalesce(cast(staked as double) / nullif(cast(minted as double), 0), 0) as share from stake) s on s.day = u.day
    left join w on w.symbol = u.symbol and w.day = u.day
    left join (select symbol, day, cast(price as double) as p from event_prices) q on q.symbol = u.symbol and q.day = u.day""")


def breakdown(t: Tables):
    def mean_of(kind):
        return t.of_type(kind).groupBy(F.col("pool").alias("symbol"), "day").agg(P.mean("value").alias("reserves"))

    share = Q.staked_share(t.transfers, "P2", STAKERS, EVENTS_START, EVENTS_AS_OF)
    rewards = t.of_type("signup").select(F.col("pool").alias("symbol"), "day", F.col("value").alias("amount"))
    units = I.unit_supply(t.ev_issuance, EVENTS_START, EVENTS_AS_OF)
    return Q.supply_breakdown(units, mean_of("click"), mean_of("view"), share, rewards, t.event_prices)


@report("l15_supply_breakdown", sql("brk", "select * from brk"))
def _(t):
    return breakdown(t)


@report("l15_supply_breakdown_total", sql("brk", """
    select symbol, day, round(tvl, 6) as tvl, round(itvl, 6) as itvl, round(utvl, 6) as utvl, round(liquidity_value, 6) as liquidity_value from brk
    union all select 'Total', day, round(sum(tvl), 6), round(sum(itvl), 6), round(sum(utvl), 6), round(sum(liquidity_value), 6) from brk group by day"""))
def _(t):
    return rnd(Q.supply_breakdown_total(breakdown(t)), 6, "tvl", "itvl", "utvl", "liquidity_value")


@report("j27_trend_supply_parts", sql("brk", """,
    parts as (select symbol || '/' || part as symbol, day, amount from (
      select symbol, day, unnest(['incentivized', 'unincentivized', 'liquidity']) as part, unnest([incentivized, unincentivized, liquidity]) as amount from brk))"""
    + _trend_sql("parts", "amount", False, True, 14).lstrip()))
def _(t):
    # the events span one month, so the longer change is one over 14 days
    parts = breakdown(t).unpivot(["symbol", "day"], ["incentivized", "unincentivized", "liquidity"], "part", "amount")
    rows = parts.select(F.concat_ws("/", "symbol", "part").alias("symbol"), "day", "amount")
    return rnd(trend(rows, ["symbol"], "day", "amount", month=14), 9, "wow_ma", "mom_ma")


# baskets: an order is a mint, its lines are the components that went in
define_view("comp", "ord lines", """
    with m as (select day, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(amount, o_orderkey) as q from ord group by day)
    select m.day, l.brand as component, cast(sum(l.qty) as double) / nullif(cast(max(m.q) as double), 0) as units
    from m join lines l on l.l_orderkey = m.o_orderkey group by all""")
define_view("brand_px", "lines", f"""
    select brand as component, day, cast({_ratio4('sum(paid)', 'sum(qty)')} as decimal(18,4)) as price from lines group by all""")



def _nav_sql(comp: str, px: str, steps: str, at: str, as_of: str) -> str:
    """Dense form: every component on every calendar step, both values carried."""
    return f"""
    with m as (select component, min({at}) as i, case when max({at}) < (select max({at}) from {comp}) then max({at}) else {as_of} end as o from {comp} group by component),
    g as (select m.component, i, o, d.{at}, cast(p.price as double) as price, c.units from m cross join {steps} d
          left join {px} p on p.component = m.component and p.{at} = d.{at} left join {comp} c on c.component = m.component and c.{at} = d.{at}),
    r as (select {at}, i, o, last_value(price ignore nulls) over w * last_value(units ignore nulls) over w as v
          from g window w as (partition by component order by {at} rows unbounded preceding))
    select {at}, sum(v) as nav from r where {at} between i and o and v is not null group by {at}"""


define_view("navs", "comp brand_px order_days", _nav_sql("comp", "brand_px", "order_days", "day", "date '2001-08-01'"))


def basket(t: Tables):
    mints = t.orders.select("tx_hash", "day", "o_orderkey", F.col("amount").alias("quantity"))
    legs = t.lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tx_hash"), F.col("brand").alias("component"), F.col("qty").alias("amount"))
    return N.composition(mints, legs, "day", ["o_orderkey"])


def nav(t: Tables):
    px = t.lines.groupBy(F.col("brand").alias("component"), "day").agg(ratio4(F.sum("paid"), F.sum("qty")).alias("price"))
    return N.basket_nav(basket(t), px, "day", ORDERS_AS_OF)


@report("m01_composition", sql("comp", "select * from comp"))
def _(t):
    return basket(t)


@report("m02_nav_vs_market", sql("navs prices", """
    select p.day, cast(p.price as double) as market_price, round(nav, 4) as nav from prices p left join navs on navs.day = p.day where p.symbol = 'P0'"""))
def _(t):
    return rnd(N.nav_vs_market(nav(t), t.prices.where("symbol = 'P0'"), "day"), 4, "nav")


@report("m02_nav_vs_market_recent", sql("navs prices", """
    select p.day, cast(p.price as double) as market_price, round(nav, 4) as nav from prices p left join navs on navs.day = p.day
    where p.symbol = 'P0' and p.day >= date '2001-07-01'"""))
def _(t):
    return rnd(N.nav_vs_market(nav(t), t.prices.where("symbol = 'P0'"), "day", since="2001-07-01"), 4, "nav")


# finer steps, in the events family: a sign-up mints, the pools traded in its transaction are the components
def _fine_views(unit: str) -> None:
    define_view(f"comp_{unit}", "ev", f"""
        with m as (select date_trunc('{unit}', ts) as {unit}, arg_max(tx_hash, event_id) as tx_hash, arg_max(value, event_id) as q from ev where event_type = 'signup' group by 1)
        select m.{unit}, e.pool as component, cast(sum(e.value) as double) / nullif(cast(max(m.q) as double), 0) as units
        from m join ev e on e.tx_hash = m.tx_hash where e.event_type in ('view', 'click') group by all""")
    define_view(f"px_{unit}", "ev", f"""
        select pool as component, date_trunc('{unit}', ts) as {unit}, cast({_ratio4('sum(value)', 'count(*)')} as decimal(18,4)) as price
        from ev where event_type in ('view', 'click') group by all""")
    define_view(f"steps_{unit}", "", f"select h as {unit} from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 {unit}) g(h)")
    define_view(f"navs_{unit}", f"comp_{unit} px_{unit} steps_{unit}", _nav_sql(f"comp_{unit}", f"px_{unit}", f"steps_{unit}", unit, "timestamp '2024-01-31'"))


def fine_basket(t: Tables, unit: str):
    """Composition per hour or minute, and the trades behind it."""
    e = t.ev.withColumn(unit, F.date_trunc(unit, "ts"))
    traded = e.where(F.col("event_type").isin("view", "click"))
    mints = e.where("event_type = 'signup'").select("tx_hash", unit, "event_id", F.col("value").alias("quantity"))
    comp = N.composition(mints, traded.select("tx_hash", F.col("pool").alias("component"), F.col("value").alias("amount")), unit, ["event_id"])
    return comp, traded


def fine_nav(t: Tables, unit: str):
    """Basket value and pool price of P0 per hour or minute."""
    comp, traded = fine_basket(t, unit)
    px = traded.groupBy(F.col("pool").alias("component"), unit).agg(ratio4(F.sum("value"), F.count(F.lit(1))).alias("price"))
    return N.nav_vs_market(N.basket_nav(comp, px, unit, EVENTS_AS_OF, f"1 {unit}"), px.where("component = 'P0'"), unit)


for _unit in ("hour", "minute"):
    _fine_views(_unit)

    @report(f"m02_nav_vs_market_{_unit}", sql(f"navs_{_unit}", f"""
        select p.{_unit}, cast(p.price as double) as market_price, round(nav, 4) as nav from px_{_unit} p left join navs_{_unit} n on n.{_unit} = p.{_unit} where p.component = 'P0'"""))
    def _(t, unit=_unit):
        return rnd(fine_nav(t, unit), 4, "nav")


define_view("pool_px", "vwap_hours", "select symbol as component, hour, price_filled as price from vwap_hours where price_filled is not null")
define_view("navs_pools", "comp_hour pool_px steps_hour", _nav_sql("comp_hour", "pool_px", "steps_hour", "hour", "timestamp '2024-01-31'"))


def pool_nav(t: Tables):
    """Basket value and market price from volume-weighted pool prices times the base price, gaps carried."""
    comp, _ = fine_basket(t, "hour")
    px = vwap_hours(t).where("price_filled is not null").select(F.col("symbol").alias("component"), "hour", F.col("price_filled").alias("price"))
    return N.basket_nav(comp, px, "hour", EVENTS_AS_OF, "1 hour"), px.where("component = 'P0'")


@report("m02_nav_vs_market_pools", sql("navs_pools", """
    select p.hour, price as market_price, round(nav, 4) as nav from pool_px p left join navs_pools n on n.hour = p.hour where p.component = 'P0'"""))
def _(t):
    nav_, market = pool_nav(t)
    return rnd(N.nav_vs_market(nav_, market, "hour"), 4, "nav")


@report("m09_premium_discount_pools", sql("navs_pools", """,
    m as (select hour, avg(price) over (order by hour rows 11 preceding) as market_price from pool_px where component = 'P0')
    select n.hour, round(nav, 4) as nav, round(market_price, 6) as market_price, round((market_price - nav) / nullif(nav, 0), 9) as premium
    from navs_pools n join m on m.hour = n.hour where nav is not null and market_price is not null"""))
def _(t):
    nav_, market = pool_nav(t)
    return rnd(rnd(rnd(N.premium_discount(nav_, market, "hour"), 4, "nav"), 6, "market_price"), 9, "premium")


@report("m09_premium_discount", sql("navs prices", """,
    m as (select day, cast(sum(price) over w as double) / count(price) over w as market_price from prices where symbol = 'P0' window w as (order by day rows 11 preceding))
    select n.day, round(nav, 4) as nav, market_price, round((market_price - nav) / nullif(nav, 0), 9) as premium
    from navs n join m on m.day = n.day where nav is not null and market_price is not null"""))
def _(t):
    return rnd(rnd(N.premium_discount(nav(t), t.prices.where("symbol = 'P0'"), "day"), 4, "nav"), 9, "premium")


define_view("levs", "ev", """
    with h as (select pool as product, date_trunc('hour', ts) as hour, cast(sum(value) filter (where event_type = 'view') as double) as collateral,
                      cast(sum(value) filter (where event_type = 'click') as double) as reward,
                      cast(sum(value) filter (where event_type = 'error') as double) / count(*) filter (where event_type = 'error') as debt,
                      cast(sum(value) filter (where event_type = 'signup') as double) / count(*) filter (where event_type = 'signup') as collateral_usd,
                      cast(sum(value) filter (where event_type = 'purchase') as double) / count(*) filter (where event_type = 'purchase') as debt_usd,
                      count(*) filter (where event_type in ('view', 'click')) as n from ev group by all),
    f as (select product, hour, n, last_value(collateral ignore nulls) over w as collateral, last_value(reward ignore nulls) over w as reward,
                 last_value(debt ignore nulls) over w as debt, last_value(collateral_usd ignore nulls) over w as collateral_usd,
                 last_value(debt_usd ignore nulls) over w as debt_usd
          from h window w as (partition by product order by hour rows unbounded preceding))
    select product, hour, collateral, reward, debt, collateral_usd, debt_usd, collateral * collateral_usd as assets, debt * debt_usd as liabilities,
           collateral * collateral_usd / nullif(debt * debt_usd, 0) as leverage_ratio from f where n > 0""")


def leverage(t: Tables):
    h = [F.col("pool").alias("product"), F.date_trunc("hour", "ts").alias("hour")]
    kind, v = F.col("event_type"), F.col("value")
    bal = t.of_type("view", "click").groupBy(*h).agg(
        F.sum(F.when(kind == "view", v)).alias("collateral"), F.sum(F.when(kind == "click", v)).alias("reward")
    )
    debt = t.of_type("error").groupBy(*h).agg(P.mean("value").alias("debt"))
    cpx = t.of_type("signup").groupBy(*h).agg(P.mean("value").alias("collateral_usd"))
    dpx = t.of_type("purchase").groupBy(*h).agg(P.mean("value").alias("debt_usd"))
    return N.leverage_ratio(bal, debt, cpx, dpx)


@report("m03_leverage_ratio", sql("levs", "select * from levs"))
def _(t):
    return leverage(t)


@report("m04_leveraged_nav", sql("levs ev_issuance swaps", """,
    l as (select product, cast(hour as date) as day, max(hour) as hour, arg_max(assets - liabilities, hour) as net_assets from levs where assets - liabilities is not null group by all),
    u as (select symbol, hour, sum(a) over (partition by symbol order by hour) as units from (
            select symbol, date_trunc('hour', ts) as hour, sum(case evt_type when 'Issue' then amount else -amount end) as a from ev_issuance group by all)),
    m as (select pool, hour, cast(sum(amount1) as double) / nullif(cast(sum(amount0) as double), 0) as p from swaps group by all)
    select l.product, l.day, l.hour, net_assets, net_assets / nullif(cast(units as double), 0) as net_nav, m.p as market_price
    from l left join u on u.symbol = l.product and u.hour = l.hour left join m on m.pool = l.product and m.hour = l.hour"""))
def _(t):
    per = t.ev_issuance.groupBy(F.col("symbol").alias("product"), F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(I.signed_amount()).alias("a"))
    supply = per.select("product", "hour", running_sum("a", ["product"], "hour").alias("units"))
    market = t.swaps.groupBy(F.col("pool").alias("product"), "hour").agg(safe_div(F.sum("amount1"), F.sum("amount0")).alias("price"))
    return N.leveraged_nav(leverage(t), supply, market)


@report("m05_vs_underlying", sql("swaps hour_px", """,
    r as (select pool as product, hour, cast(day as date) as day, event_type, cast(amount0 as double) / (amount1 + 1) as r from swaps),
    x as (select a.product, a.day, a.r as r2, b.r as r3, p.price from r a join hour_px p on p.hour = a.hour and p.symbol = 'B0'
          left join r b on b.product = a.product and b.hour = a.hour and b.event_type = 'click' where a.event_type = 'view'),
    g as (select product, day, 1 / avg(r2) * avg(price) as p2, 1 / avg(r3) * avg(price) as p3, avg(price) as underlying from x group by all)
    select product, day, round((coalesce(p2, 0) + coalesce(p3, 0)) / ((p2 is not null)::int + (p3 is not null)::int), 6) as product_price, round(underlying, 6) as underlying from g"""))
def _(t):
    s = t.swaps.select(F.col("pool").alias("product"), "hour", "event_type", (F.col("amount0").cast("double") / (F.col("amount1") + 1)).alias("ratio"))
    px = hour_prices(t).where("symbol = 'B0'")
    out = N.vs_underlying(px, s.where("event_type = 'view'"), s.where("event_type = 'click'"), "hour", F.to_date("hour"), "day")
    return rnd(out, 6, "product_price", "underlying")


def accruals(t: Tables):
    rows = t.of_type("click").where(F.col("pool").isin("P0", "P1", "P2"))
    return rows.select(F.col("pool").alias("market"), "day", F.col("value").alias("cash"), F.col("k").alias("borrows"), (F.col("value") / 100).alias("interest"))


define_view("acc", "ev event_days", f"""
    with a as (select pool as market, day, cast(sum(value) as double) / count(*) as cash, cast(sum(k) as double) / count(*) as borrows,
                      cast(sum(value) as double) / 100.0 / count(*) as interest from ev where event_type = 'click' and pool in ('P0', 'P1', 'P2') group by all)
    select market, e.day, cash, borrows, interest from (select *, lead(day, 1, {AS_OF_X}) over (partition by market order by day) as nxt from a) s
    join event_days e on e.day >= s.day and e.day < s.nxt""")


@report("m06_utilisation", sql("acc ev ev_issuance event_days", f""",
    lo as (select market, e.day, b as borrowed from (
        select *, lead(day, 1, {AS_OF_X}) over (partition by market order by day) as nxt, cast(sum(a) over (partition by market order by day) as double) as b from (
          select pool as market, day, sum(case event_type when 'purchase' then value else -value end) as a from ev
          where event_type in ('purchase', 'error') and pool in ('P3', 'P4') group by all)) s join event_days e on e.day >= s.day and e.day < s.nxt),
    b as (select market, day, borrows as borrowed, cash + borrows as pool from acc union all select market, day, borrowed, null from lo),
    u as (select e.day, cast(sum(coalesce(a, 0)) over (order by e.day) as double) as units from event_days e
          left join (select day, sum(case evt_type when 'Issue' then amount else -amount end) as a from ev_issuance group by day) x on x.day = e.day),
    m as (select pool as market, day, cast(sum(value) as double) as amount, cast(sum(value * k) as double) as amount_usd from ev where event_type = 'view' group by all)
    select m.market, m.day, amount, amount / nullif(units, 0) as percent_of_supply, amount_usd / nullif(amount, 0) as token_usd, borrowed,
           borrowed / nullif(coalesce(pool, amount + borrowed), 0) as utilization, borrowed * (amount_usd / nullif(amount, 0)) as borrowed_usd
    from m left join u on u.day = m.day left join b on b.market = m.market and b.day = m.day"""))
def _(t):
    bal = t.of_type("view").groupBy(F.col("pool").alias("market"), "day").agg(F.sum("value").alias("amount"), F.sum(F.col("value") * F.col("k")).alias("amount_usd"))
    rows = t.of_type("purchase", "error").where(F.col("pool").isin("P3", "P4"))
    loans = rows.select(F.col("pool").alias("market"), "day", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value")).alias("amount"))
    supply = I.unit_supply(t.ev_issuance, EVENTS_START, EVENTS_AS_OF, by=())
    return D.utilisation(bal, accruals(t), loans, supply, EVENTS_AS_OF)


@report("m07_lending_apy", sql("acc ev event_days", f""",
    q as (select pool as market, day, event_type, arg_max(k, event_id) as k from ev where event_type in ('signup', 'purchase') and pool in ('P3', 'P4') group by all),
    e as (select market, d.day, event_type, k * 1e20::double / 1e27::double as rate from (
            select *, lead(day, 1, {AS_OF_X}) over (partition by market, event_type order by day) as nxt from q) s join event_days d on d.day >= s.day and d.day < s.nxt)
    select market, day, round(interest / nullif(cash + borrows, 0) * 365, 9) as supply_rate,
           round(case when borrows = 0 then 0 else interest / borrows * 365 end, 9) as borrow_rate from acc
    union all select s.market, s.day, round(s.rate, 15), round(b.rate, 15) from e s join e b on b.market = s.market and b.day = s.day and b.event_type = 'purchase' where s.event_type = 'signup'"""))
def _(t):
    def quoted(kind):
        rows = t.of_type(kind).where(F.col("pool").isin("P3", "P4"))
        return rows.select(F.col("pool").alias("market"), "day", F.col("event_id").alias("order"), (F.col("k") * F.lit(1e20)).alias("rate"))

    out = D.lending_apy(accruals(t), quoted("signup"), quoted("purchase"), EVENTS_AS_OF)
    digits = F.col("market").isin("P3", "P4")
    return out.select("market", "day", *[F.when(digits, F.round(c, 15)).otherwise(F.round(c, 9)).alias(c) for c in ("supply_rate", "borrow_rate")])


@report("m08_rebalance", sql("", """
    , p as (select s_nationkey as pool, s_suppkey as idx, s_acctbal as balance, s_acctbal / sum(s_acctbal) over (partition by s_nationkey) as weight,
                   1.0::double + s_suppkey % 7 as spot from supplier where s_acctbal > 0),
    f as (select *, min(idx) over (partition by pool) as h, arg_min(weight, idx) over (partition by pool) as w1 from p),
    b as (select pool, exp(sum(weight * ln(balance)) + coalesce(sum(weight * ln(spot * w1 / weight)) filter (where idx <> h), 0)) as b1 from f group by pool)
    select cast(f.pool as bigint) as pool, idx, balance, round(case when idx = h then b1 else b1 / spot * weight / w1 end, 5) as new_balance from f join b on b.pool = f.pool"""))
def _(t):
    s = t.raw("supplier").where("s_acctbal > 0")
    total = s.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("total"))
    rows = s.join(total, "s_nationkey").select(
        F.col("s_nationkey").alias("pool"), F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("balance"), (F.col("s_acctbal") / F.col("total")).alias("weight"),
        (F.lit(1.0) + F.pmod("s_suppkey", F.lit(7))).alias("spot"),
    )
    return rnd(N.rebalance(rows), 5, "new_balance")
