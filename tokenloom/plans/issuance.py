"""Issuance, supply, price, revenue, flow and volume reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_div, split_list
from ..functions.windows import previous
from ..operators import flows as FL
from ..operators import issuance as I
from ..operators import ledger as L
from ..operators import prices as P
from ..operators import revenue as R
from ..operators import timeseries as T
from ..session import scratch_path
from ..sources.canonical import EVENTS_AS_OF, EVENTS_START, ORDERS_AS_OF, ORDERS_START, Tables
from ..sources.seeds import fees, products
from ..streaming import balances as Z
from .ledger import changes as holder_changes
from .registry import define_view, report, rnd, sql

SYMBOLS = ["P0", "P1", "P2", "P3", "P4"]
IN_SYMBOLS = "('P0', 'P1', 'P2', 'P3', 'P4')"

define_view("iss", "issued redeemed exchange_txs", """
    select e.*, case when tx_hash in (select tx_hash from exchange_txs) then 'Exchange' else 'Standard' end as use_type
    from (select *, 'Issue' as evt_type from issued union all select *, 'Redeem' from redeemed) e""")
define_view("iss_daily", "iss order_days", """
    select g.symbol, g.day, coalesce(i, 0) as issued, coalesce(r, 0) as redeemed, coalesce(i, 0) - coalesce(r, 0) as net,
           coalesce(i, 0) + coalesce(r, 0) as gross,
           sum(coalesce(i, 0) - coalesce(r, 0)) over (partition by g.symbol order by g.day) as supply
    from (select symbol, order_days.day from (select symbol, min(day) as f from iss group by symbol) s join order_days on order_days.day >= f) g
    left join (select symbol, day, sum(amount) filter (where evt_type = 'Issue') as i, sum(amount) filter (where evt_type = 'Redeem') as r
               from iss group by all) x on x.symbol = g.symbol and x.day = g.day""")
define_view("units", "iss order_days", """
    select s.symbol, d.day, sum(coalesce(x.a, 0)) over (partition by s.symbol order by d.day) as units
    from (select distinct symbol from iss) s cross join order_days d
    left join (select symbol, day, sum(case when evt_type = 'Issue' then amount else -amount end) as a from iss group by all) x
      on x.symbol = s.symbol and x.day = d.day""")
define_view("fl", "iss_daily prices", """
    select i.symbol, i.day, cast(supply as double) * cast(price as double) as aum, cast(net as double) * cast(price as double) as net_inflow
    from iss_daily i left join prices p on p.symbol = i.symbol and p.day = i.day""")
define_view("flc", "fl", "select *, sum(net_inflow) over (partition by symbol order by day rows unbounded preceding) as cum_inflow from fl")
define_view("rev", "iss_daily prices fees", """
    select a.symbol, a.day, partner, partner_split, aum * (streaming_fee / 365.0::double) as streaming_revenue,
           iu * issue_fee + ru * redeem_fee as issue_redeem_revenue,
           aum * (streaming_fee / 365.0::double) + (iu * issue_fee + ru * redeem_fee) as total_revenue
    from (select i.symbol, i.day, coalesce(cast(supply as double) * cast(price as double), 0) as aum,
                 coalesce(cast(issued as double) * cast(price as double), 0) as iu, coalesce(cast(redeemed as double) * cast(price as double), 0) as ru
          from iss_daily i left join prices p on p.symbol = i.symbol and p.day = i.day) a
    left join fees f on f.symbol = a.symbol and a.day between f.begin_date and f.end_date""")
RATE = {"P0": 0.0095, "P1": 0.0095, "P2": 0.0195, "P3": 0.0195, "P4": 0.0025}
MOVE = {"P2": 0.001, "P3": 0.0006}


def _case(rates: dict[str, float]) -> str:
    return "case symbol " + " ".join(f"when '{k}' then {v}::double" for k, v in rates.items()) + " else 0 end"


define_view("funds", "units prices", """
    select u.symbol, u.day, u.units, cast(price as double) as price, cast(units as double) * cast(price as double) as aum
    from units u left join prices p on p.symbol = u.symbol and p.day = u.day""")
define_view("revc", "funds iss_daily", f"""
    select symbol, day, aum, aum * r / 365.0::double as streaming, coalesce(g * price * m, 0) as mint_redeem,
           aum * r / 365.0::double + coalesce(g * price * m, 0) as revenue
    from (select u.*, cast(i.gross as double) as g, {_case(RATE).replace('symbol', 'u.symbol')} as r, {_case(MOVE).replace('symbol', 'u.symbol')} as m
          from funds u left join iss_daily i on i.symbol = u.symbol and i.day = u.day)""")
define_view("vol", "trades base_prices", f"""
    select product, day, sum(amt * price) as usd_volume from (
      select distinct tx_hash, trace, evt_index, day, minute, case when token_a in {IN_SYMBOLS} then token_a else token_b end as product,
             case when token_a in {IN_SYMBOLS} then token_b else token_a end as base,
             case when token_a in {IN_SYMBOLS} then amount_b else amount_a end as amt
      from trades) t join base_prices b on b.minute = t.minute and b.symbol = t.base group by all""")


def events(t: Tables):
    return I.issuance_events([("Issue", t.issued), ("Redeem", t.redeemed)], t.exchange_txs)


def daily(t: Tables):
    return I.issuance_daily(events(t), ORDERS_AS_OF)


def flow(t: Tables):
    return FL.flows(daily(t), t.prices)


def revenue(t: Tables):
    return R.revenue_daily(daily(t), t.prices, fees(t.spark))


def constant_revenue(t: Tables):
    funds = R.aum(I.supply_and_moves(t.moves, ORDERS_START, ORDERS_AS_OF), t.prices)
    return R.revenue_const(funds, None, RATE, MOVE)


@report("j01_issuance_events", sql("iss", "select ts, day, tx_hash, symbol, wallet, cast(amount as double) as amount, evt_type, use_type from iss"))
def _(t):
    return events(t)


DOUBLES = "cast(issued as double) as issued, cast(redeemed as double) as redeemed, cast(net as double) as net, cast(gross as double) as gross, cast(supply as double) as supply"


@report("j02_issuance_daily", sql("iss_daily", f"select symbol, day, {DOUBLES} from iss_daily"))
def _(t):
    return daily(t)


@report("j03_issuance_hourly", sql("ev_issuance event_hours", f"""
    , g as (select s.symbol, h.hour from (select symbol, date_trunc('hour', min(ts)) as f from ev_issuance group by symbol) s join event_hours h on h.hour >= f),
    x as (select symbol, date_trunc('hour', ts) as hour, sum(amount) filter (where evt_type = 'Issue') as i,
                 sum(amount) filter (where evt_type = 'Redeem') as r from ev_issuance group by all),
    y as (select g.symbol, g.hour, coalesce(i, 0) as issued, coalesce(r, 0) as redeemed, coalesce(i, 0) - coalesce(r, 0) as net,
                 coalesce(i, 0) + coalesce(r, 0) as gross,
                 sum(coalesce(i, 0) - coalesce(r, 0)) over (partition by g.symbol order by g.hour) as supply
          from g left join x on x.symbol = g.symbol and x.hour = g.hour)
    select symbol, hour, {DOUBLES} from y"""))
def _(t):
    return I.issuance_hourly(t.ev_issuance, EVENTS_AS_OF)


@report("j04_unit_supply", sql("units", "select symbol, day, cast(units as double) as units from units"))
def _(t):
    return I.unit_supply(events(t), ORDERS_START, ORDERS_AS_OF)


@report("j04_unit_supply_total", sql("units", "select day, cast(sum(units) as double) as units from units group by day"))
def _(t):
    return I.unit_supply(events(t), ORDERS_START, ORDERS_AS_OF, by=())


def _mint_sql(by: str) -> str:
    sym = "s.symbol, " if by else ""
    return sql("iss order_days", f""",
    x as (select {by} day, sum(amount) as a from iss where evt_type = 'Issue' group by all),
    g as (select {sym} d.day, coalesce(x.a, 0) as amount from {"(select distinct symbol from iss) s cross join" if by else ""} order_days d
          left join x on x.day = d.day {"and x.symbol = s.symbol" if by else ""})
    select {by} day, cast(amount as double) as amount, cast(sum(amount) over w as double) / count(amount) over w as av
    from g window w as ({"partition by symbol" if by else ""} order by day rows 7 preceding)""")


@report("j04_unit_supply_incremental", sql("units", "select symbol, day, cast(units as double) as units from units"))
def _(t):
    """Supply kept as stored intervals: taken in by two steps, the days made from them."""
    store, as_of = scratch_path(t.spark, "supply"), "1998-06-30"
    moves = t.moves.groupBy(F.col("symbol").alias("token"), F.lit("").alias("holder"), "day").agg(F.sum(I.signed_amount()).alias("change"))
    moves = moves.where(F.col("day") >= F.lit(ORDERS_START).cast("date"))
    Z.create(t.spark, store)
    Z.advance(moves, store, as_of)
    Z.advance(moves, store, ORDERS_AS_OF)
    known = T.expand_intervals(Z.intervals(t.spark, store), "day", "next_day", "day").select(F.col("token").alias("symbol"), "day", F.col("balance").alias("units"))
    grid = known.select("symbol").distinct().crossJoin(F.broadcast(T.spine(t.spark, ORDERS_START, ORDERS_AS_OF)))
    return grid.join(known, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("units", F.lit(0)).alias("units"))


@report("j05_mint_volume", _mint_sql("symbol,"))
def _(t):
    return I.mint_volume(events(t), ORDERS_START, ORDERS_AS_OF)


@report("j05_mint_volume_total", _mint_sql(""))
def _(t):
    return I.mint_volume(events(t), ORDERS_START, ORDERS_AS_OF, by=())


@report("j06_mint_redeem", sql("iss_daily prices", """,
    x as (select i.symbol, i.day, issued as mv, -redeemed as rv, net as nv, cast(price as double) as p
          from iss_daily i left join prices q on q.symbol = i.symbol and q.day = i.day)
    select symbol, day, cast(mv as double) as mint_volume, cast(rv as double) as redeem_volume, cast(nv as double) as net_volume,
           cast(mv as double) * p as mint_usd, cast(rv as double) * p as redeem_usd, cast(nv as double) * p as net_usd,
           cast(sum(nv) over w as double) / count(nv) over w as av,
           round(sum(cast(nv as double) * p) over w / count(p) over w, 4) as av_usd
    from x window w as (partition by symbol order by day rows 7 preceding)"""))
def _(t):
    return rnd(I.mint_redeem(daily(t), t.prices), 4, "av_usd")


TYPE_COLS = ["std_mint", "std_redeem", "std_net", "exchange_mint", "exchange_redeem", "exchange_net"]


def _type_sum(name: str) -> str:
    use, kind = ("Standard" if name.startswith("std") else "Exchange"), name.split("_")[1]
    val = {"mint": "case when evt_type = 'Issue' then amount end", "redeem": "case when evt_type = 'Redeem' then -amount end",
           "net": "case when evt_type = 'Issue' then amount else -amount end"}[kind]
    return f"sum({val}) filter (where use_type = '{use}') as {name}"


@report("j07_issuance_type", sql("iss prices order_days", f""",
    x as (select symbol, day, {", ".join(_type_sum(c) for c in TYPE_COLS)} from iss group by all),
    u as (select s.symbol, d.day, {", ".join(f"coalesce(cast(x.{c} as double), 0) * cast(p.price as double) as {c}_usd" for c in TYPE_COLS)}
          from (select distinct symbol from iss) s cross join order_days d
          left join x on x.symbol = s.symbol and x.day = d.day left join prices p on p.symbol = s.symbol and p.day = d.day)
    select symbol, day, {", ".join(f"{c}_usd" for c in TYPE_COLS)}, {", ".join(f"round(sum({c}_usd) over w, 0) as cum_{c}" for c in TYPE_COLS)}
    from u window w as (partition by symbol order by day rows unbounded preceding)"""))
def _(t):
    return rnd(I.issuance_type(events(t), t.prices, ORDERS_START, ORDERS_AS_OF), 0, *[f"cum_{c}" for c in TYPE_COLS])


TOPIC = "0x44b3"


@report("j08_exchange_volume", sql("ord base_prices", f""",
    logs as (select ts as minute, day, case when o_orderstatus = 'P' then '{TOPIC}' else '0x00' end as topic1, symbol,
                    'B' || cast(o_custkey % 4 as varchar) as paid_in, cast(o_orderkey * 1000000007 as double) as raw from ord),
    px as (select *, case symbol when 'B0' then 18 when 'B1' then 8 else 6 end as decimals from base_prices)
    select l.day, round(sum(coalesce(cast(p.price as double), cast(f.price as double)) / power(10.0, coalesce(p.decimals, f.decimals)) * raw), 2) as volume
    from logs l left join px p on p.minute = l.minute and p.symbol = l.paid_in left join px f on f.minute = l.minute and f.symbol = 'B0'
    where topic1 = '{TOPIC}' and l.symbol = 'P0' group by l.day"""))
def _(t):
    def word(c):
        return F.lpad(c, 64, "0")

    logs = t.orders.select(
        F.col("ts").alias("minute"), "day",
        F.when(F.col("o_orderstatus") == "P", F.lit(TOPIC)).otherwise(F.lit("0x00")).alias("topic1"),
        F.concat(F.lit("0x"), word(F.concat(F.lit("a"), F.substring("symbol", 2, 2)))).alias("topic3"),
        F.concat(F.lit("0x"), word(F.concat(F.lit("b"), F.pmod("o_custkey", F.lit(4)).cast("string")))).alias("topic4"),
        F.concat(F.lit("0x"), word(F.hex(F.col("o_orderkey") * 1000000007)), word(F.lit("1"))).alias("data"),
    )
    px = t.base_prices.withColumns({
        "contract": F.lpad(F.lower("symbol"), 64, "0"),
        "decimals": F.when(F.col("symbol") == "B0", 18).when(F.col("symbol") == "B1", 8).otherwise(6),
    })
    return rnd(P.exchange_volume(logs, TOPIC, "a0".rjust(64, "0"), px, "B0"), 2, "volume")


@report("j08_exchange_amounts_exact", sql("ord", f"""
    select day, lpad('b' || cast(o_custkey % 4 as varchar), 64, '0') as contract, count(*) as n, (sum(o_orderkey)::hugeint * {2**80})::varchar as raw_amount
    from ord where o_orderstatus = 'P' group by all"""))
def _(t):
    paid_in = F.concat(F.lit("b"), F.pmod("o_custkey", F.lit(4)).cast("string"))
    logs = t.orders.where(F.col("o_orderstatus") == "P").select(
        "day", F.lit(TOPIC).alias("topic1"), F.concat(F.lit("0x"), F.lpad(paid_in, 64, "0")).alias("topic4"),
        F.concat(F.lit("0x"), F.lpad(F.concat(F.hex("o_orderkey"), F.lit("0" * 20)), 64, "0")).alias("data"),
    )
    return P.exchange_amounts(logs, TOPIC)


define_view("feed", "swaps base_minutes event_hours", """
    select product, hour, last_value(u ignore nulls) over w as usd_price, last_value(r ignore nulls) over w as base_ratio
    from (select s.product, h.hour, x.r, x.r * b.p as u
          from (select distinct pool as product from swaps) s cross join event_hours h
          left join (select pool, hour, avg(cast(amount1 as double) / nullif(cast(amount0 as double), 0)) as r from swaps group by all) x
            on x.pool = s.product and x.hour = h.hour
          left join (select date_trunc('hour', minute) as hour, cast(sum(price) as double) / count(price) as p
                     from base_minutes where symbol = 'B0' group by all) b on b.hour = h.hour)
    window w as (partition by product order by hour rows unbounded preceding)""")


def feed(t: Tables):
    ratio = safe_div(F.col("amount1"), F.col("amount0"))
    sw = t.swaps.select(F.col("pool").alias("product"), "hour", ratio.alias("ratio"))
    return P.swap_price_feed(sw, t.base_minutes.where("symbol = 'B0'"), EVENTS_START, EVENTS_AS_OF)


@report("j09_swap_price_feed", sql("feed", """
    select product, hour, round(usd_price, 6) as usd_price, round(base_ratio, 6) as base_ratio from feed where usd_price is not null"""))
def _(t):
    return rnd(feed(t), 6, "usd_price", "base_ratio")


@report("j10_daily_price", sql("feed ev", """,
    ref as (select pool as symbol, day, cast(max(value) as double) as price from ev where value > 100 group by all),
    f as (select product as symbol, cast(hour as date) as day, avg(usd_price) as price from feed where usd_price is not null group by all)
    select symbol, day, price from ref union all
    select symbol, day, round(price, 6) from f where not exists (select 1 from ref where ref.symbol = f.symbol and ref.day = f.day)"""))
def _(t):
    ref = t.ev.where("value > 100").groupBy(F.col("pool").alias("symbol"), "day").agg(F.max("value").alias("price"))
    return rnd(P.daily_price(ref, feed(t)), 6, "price")


@report("j11_median_trade_price", sql("trades base_prices", f""",
    s as (select minute, day, token_a as symbol, token_b as base, cast(amount_b as double) / nullif(cast(amount_a as double), 0) as r from trades
          union all select minute, day, token_b, token_a, cast(amount_a as double) / nullif(cast(amount_b as double), 0) from trades)
    select s.symbol, s.day, percentile_cont(0.5) within group (order by r * cast(b.price as double)) as price
    from s left join base_prices b on b.minute = s.minute and b.symbol = s.base
    where s.symbol in {IN_SYMBOLS} and s.base in ('B0', 'B1') group by all having count(b.price) > 0"""))
def _(t):
    return P.median_trade_price(t.trades, t.base_prices, SYMBOLS, ["B0", "B1"])


def base_hours(t: Tables):
    return P.hourly_base(t.base_minutes.withColumnRenamed("symbol", "base"), ["base"])


@report("j12_pool_price", sql("swaps base_minutes products event_days", """,
    b as (select symbol as base, date_trunc('hour', minute) as hour, cast(sum(price) as double) / count(price) as p from base_minutes group by all),
    r as (select pool, hour, 'v2' as venue, cast(amount1 as double) / nullif(cast(amount0 as double), 0) as r from swaps
          union all select pool, hour, 'v3', avg(cast(amount1 as double) / nullif(cast(amount0 as double), 0)) from swaps group by all
          union all select pool, hour, 'fork', cast(amount1 as double) / nullif(cast(amount0 as double), 0) from swaps),
    u as (select distinct r.pool, r.hour, r.r * b.p as usd from r join products p on p.symbol = r.pool and p.venue = r.venue
          join b on b.base = p.base and b.hour = r.hour),
    d as (select pool, cast(hour as date) as day, round(avg(usd), 6) as price from u group by all)
    select p.symbol, e.day, d.price from products p cross join event_days e left join d on d.pool = p.symbol and d.day = e.day"""))
def _(t):
    sw = t.swaps.select("pool", "hour", safe_div("amount1", "amount0").alias("ratio"))
    return rnd(P.pool_price(products(t.spark), sw, sw, sw, base_hours(t), EVENTS_START, EVENTS_AS_OF), 6, "price")


def venue(t: Tables, kind: str):
    return t.swaps.where(F.col("event_type") == kind).select(
        F.col("pool").alias("symbol"), "hour", F.col("amount1").alias("base_amt"), F.col("amount0").alias("token_amt")
    )


define_view("vwap_hours", "swaps base_minutes", """
    select g.symbol, g.hour, x.r * g.p as price, last_value(x.r * g.p ignore nulls) over (partition by g.symbol order by g.hour rows unbounded preceding) as price_filled
    from (select s.symbol, b.hour, b.p from (select distinct pool as symbol from swaps) s cross join
           (select date_trunc('hour', minute) as hour, cast(sum(price) as double) / count(price) as p from base_minutes where symbol = 'B0' group by all) b) g
    left join (select pool, hour, cast(sum(amount1) as double) / nullif(cast(sum(amount0) as double), 0) as r from swaps group by all) x
      on x.pool = g.symbol and x.hour = g.hour""")


def vwap_hours(t: Tables):
    return P.pooled_vwap(venue(t, "view"), venue(t, "click"), P.hourly_base(t.base_minutes.where("symbol = 'B0'")))


@report("j13_pooled_vwap", sql("vwap_hours", """
    select symbol, hour, price, price_filled, round(avg(price_filled) over (partition by symbol order by hour rows 11 preceding), 6) as price_ma from vwap_hours"""))
def _(t):
    return rnd(vwap_hours(t), 6, "price_ma")


@report("j13_latest_vwap", sql("swaps base_minutes", """,
    b as (select cast(sum(price) as double) / count(price) as b from base_minutes where symbol = 'B0' and minute >= timestamp '2024-01-30')
    select pool as symbol, cast(sum(amount1) as double) / nullif(cast(sum(amount0) as double), 0) * (select b from b) as price
    from swaps where hour >= timestamp '2024-01-30' group by pool"""))
def _(t):
    return P.latest_vwap(venue(t, "view"), venue(t, "click"), t.base_minutes.where("symbol = 'B0'"), "2024-01-30")


@report("j14_trade_volatility", sql("trades", """,
    s as (select day, token_a as token, token_b as base, amount_a as u, amount_b as p from trades
          union all select day, token_b, token_a, amount_b, amount_a from trades),
    x as (select token, day, cast(p as double) / nullif(cast(u as double), 0) as r, u, p from s where base in ('B0', 'B1') and token in ('P0', 'P2', 'P3', 'P4')),
    a as (select token, day, count(*) as num_trades, min(r) as min_price, avg(r) as av, cast(sum(p) as double) / nullif(cast(sum(u) as double), 0) as vwap,
                 max(r) as max_price, stddev(r) as sdv from x group by all)
    select token, day, num_trades, min_price, round(av + 1e-9::double, 4) as avg_price, vwap, max_price, round(sdv + 1e-9::double, 4) as sd,
           round(av - sdv + 1e-9::double, 4) as sd_below, round(av + sdv + 1e-9::double, 4) as sd_above from a"""))
def _(t):
    listed = t.spark.range(1).select(split_list(F.lit("p0, P2 ,p3,P4")).alias("x"))
    tokens = listed.select(F.upper("x").alias("token"))
    out = P.trade_volatility(t.trades, tokens, ["B0", "B1"])
    cols = ["avg_price", "sd", "sd_below", "sd_above"]
    # prices are short decimals: the shift keeps exact halves from rounding both ways
    return rnd(out.withColumns({c: F.col(c) + F.lit(1e-9) for c in cols}), 4, *cols)


@report("j15_aum", sql("units prices", """,
    alt as (select symbol, day, lag(price, 1) over (partition by symbol order by day) as price from prices)
    select u.symbol, u.day, cast(units as double) as units, cast(coalesce(p.price, a.price) as double) as price,
           cast(units as double) * cast(coalesce(p.price, a.price) as double) as aum
    from units u left join prices p on p.symbol = u.symbol and p.day = u.day left join alt a on a.symbol = u.symbol and a.day = u.day"""))
def _(t):
    alt = t.prices.select("symbol", "day", previous("price", ["symbol"], "day").alias("price"))
    return R.aum(I.unit_supply(events(t), ORDERS_START, ORDERS_AS_OF), t.prices, alt)


@report("j16_revenue_daily", sql("rev", """
    select *, total_revenue * (1.0::double - partner_split) as net_revenue, total_revenue * partner_split + 0.0::double as partner_fee from rev"""))
def _(t):
    return revenue(t)


@report("j17_revenue_const", sql("revc", """
    select symbol, day, aum, streaming, mint_redeem, revenue,
           round(avg(revenue) over (partition by symbol order by day rows 7 preceding), 4) as av from revc"""))
def _(t):
    return rnd(constant_revenue(t), 4, "av")


@report("j18_revenue_cumulative", sql("revc", """
    select symbol, day, round(sum(revenue) over (partition by symbol order by day), 1) as cum_revenue from revc"""))
def _(t):
    return rnd(R.revenue_cumulative(constant_revenue(t)), 1, "cum_revenue")


@report("j18_revenue_total", sql("revc", """,
    d as (select day, sum(revenue) as revenue from revc group by day)
    select day, round(revenue, 2) as revenue, round(avg(revenue) over (order by day rows 7 preceding), 2) as av from d"""))
def _(t):
    return rnd(R.revenue_total(constant_revenue(t)), 2, "revenue", "av")


@report("j19_partner_revenue", sql("rev", "select day, partner, round(sum(total_revenue), 4) as revenue from rev group by all"))
def _(t):
    return rnd(R.partner_revenue(revenue(t)), 4, "revenue")


@report("j20_partner_rewards", sql("rev", """,
    m as (select strftime(day, '%b %Y') as month, partner, sum(total_revenue) as r from rev group by all)
    select month, partner, round(r, 2) as revenue, round(r / sum(r) over (partition by month), 3) as contribution,
           round(41666 * (r / sum(r) over (partition by month)), 2) as reward from m"""))
def _(t):
    return R.partner_rewards(revenue(t), 41666.0)


MA_SQL = """
    , m as (select symbol, day, aum, net_inflow, avg(net_inflow) over (partition by symbol order by day rows 6 preceding) as s7,
             avg(net_inflow) over (partition by symbol order by day rows 27 preceding) as s28,
             avg(aum) over (partition by symbol order by day rows 27 preceding) as a28 from fl)"""


@report("j21_net_flow_ma", sql("fl", MA_SQL + """
    select symbol, day, aum, net_inflow, round(s7, 4) as ma_short, round(s28, 4) as ma_long, round(s28 / nullif(a28, 0), 9) as ma_long_rate from m"""))
def _(t):
    return rnd(rnd(FL.net_flow_ma(flow(t)), 4, "ma_short", "ma_long"), 9, "ma_long_rate")


@report("j21_net_flow_total", sql("fl", MA_SQL + "select day, round(sum(s28), 2) as av from m group by day"))
def _(t):
    return rnd(FL.net_flow_total(flow(t)), 2, "av")


@report("j22_cumulative_flow", sql("flc", "select symbol, day, aum, net_inflow, round(cum_inflow, 0) as cum_inflow from flc"))
def _(t):
    return rnd(FL.cumulative_flow(flow(t)), 0, "cum_inflow")


@report("j22_cum_flow_vs_aum", sql("flc order_days", """
    select d.day, round(sum(aum), 0) as aum, round(sum(cum_inflow), 0) as cum_inflow from order_days d left join flc using (day) group by d.day"""))
def _(t):
    return rnd(FL.cum_flow_vs_aum(flow(t), T.spine(t.spark, ORDERS_START, ORDERS_AS_OF)), 0, "aum", "cum_inflow")


def _growth_sql(denom: str, smooth: bool, min_days: int | None, every: bool) -> str:
    g = "avg(g) over (partition by symbol order by day rows between 14 preceding and 14 following)" if smooth else "g"
    where = " and ".join(([f"days_since_launch >= {min_days}"] if min_days else []) + (["days_since_launch % 7 = 0"] if every else []))
    return sql("flc products", f""",
    a as (select c.symbol, c.day, date_diff('day', inception, c.day) as days_since_launch,
                 sum(net_inflow) over (partition by c.symbol order by c.day rows 6 preceding)
                 / nullif(lag({denom}, 7) over (partition by c.symbol order by c.day), 0) as g
          from flc c left join products p on p.symbol = c.symbol),
    b as (select symbol, day, days_since_launch, round({g}, 7) + 0.0::double as growth from a)
    select symbol, day, days_since_launch, growth{", days_since_launch // 7 as week" if every else ""} from b {"where " + where if where else ""}""")


@report("j23_flow_growth_smoothed", _growth_sql("cum_inflow", True, 28, False))
def _(t):
    return rnd(FL.flow_growth(flow(t), products(t.spark), min_days=28), 7, "growth")


@report("j23_flow_growth_vs_aum", _growth_sql("aum", False, None, False))
def _(t):
    return rnd(FL.flow_growth(flow(t), products(t.spark), denom="aum", smooth=None), 7, "growth")


@report("j23_flow_growth_weekly", _growth_sql("cum_inflow", True, 56, True))
def _(t):
    return rnd(FL.flow_growth(flow(t), products(t.spark), min_days=56, every=7), 7, "growth")


def _period_sql(unit: str, start: str) -> str:
    return sql("fl products", f"""
    , p as (select cast(d as date) as period from generate_series(timestamp '{start}', timestamp '2001-08-01', interval 1 {unit}) g(d))
    select s.symbol, p.period, round(sum(net_inflow), 2) as net_inflow from products s cross join p
    left join fl on fl.symbol = s.symbol and cast(date_trunc('{unit}', fl.day) as date) = p.period group by all""")


@report("j24_flow_by_week", _period_sql("week", "1994-12-26"))
def _(t):
    return rnd(FL.flow_by_period(flow(t), products(t.spark), "1994-12-26", ORDERS_AS_OF, "week"), 2, "net_inflow")


@report("j24_flow_by_month", _period_sql("month", "1995-01-01"))
def _(t):
    return rnd(FL.flow_by_period(flow(t), products(t.spark), "1995-01-01", ORDERS_AS_OF, "month"), 2, "net_inflow")


def volume(t: Tables):
    return FL.trading_volume(t.trades, t.base_prices, SYMBOLS)


@report("j25_trading_volume", sql("vol", """
    select product, day, cast(usd_volume as double) as usd_volume, cast(sum(usd_volume) over w as double) / count(*) over w as av
    from vol window w as (partition by product order by day rows 7 preceding)"""))
def _(t):
    return volume(t)


@report("j25_trading_volume_total", sql("vol", """,
    d as (select day, sum(usd_volume) as v from vol group by day)
    select day, cast(v as double) as volume, cast(sum(v) over w as double) / count(*) over w as av from d window w as (order by day rows 7 preceding)"""))
def _(t):
    return FL.trading_volume_total(volume(t))


@report("j26_buys_sells", sql("trades prices", f""",
    x as (select distinct tx_hash, trace, evt_index, day, 'buy' as way, token_a as symbol, amount_a as amount from trades where token_a in {IN_SYMBOLS}
          union all select distinct tx_hash, trace, evt_index, day, 'sell', token_b, amount_b from trades where token_b in {IN_SYMBOLS}),
    d as (select symbol, day, count(*) filter (where way = 'buy') as buys, count(*) filter (where way = 'sell') as sells,
                 coalesce(cast(sum(amount) filter (where way = 'buy') as double), 0) as b, cast(sum(amount) filter (where way = 'buy') as double) as bn,
                 coalesce(cast(sum(amount) filter (where way = 'sell') as double), 0) as s, cast(sum(amount) filter (where way = 'sell') as double) as sn
          from x group by all)
    select d.symbol, d.day, buys, sells, buys - sells as net, bn * cast(price as double) as buy_volume, sn * cast(price as double) as sell_volume,
           (b - s) * cast(price as double) as net_volume, (b + s) * cast(price as double) as total_volume
    from d join prices p on p.symbol = d.symbol and p.day = d.day"""))
def _(t):
    return FL.buys_sells(t.trades, t.prices, SYMBOLS)


def _trend_sql(src: str, value: str, first: bool, last: bool, month: int = 30) -> str:
    v = f"cast(sum({value}) over w8 as double) / count({value}) over w8" if first else f"cast({value} as double)"
    return f"""
    , a as (select *, {v} as v from {src} window w8 as (partition by symbol order by day rows 7 preceding)),
    b as (select *, lag(v, 7) over w as last_week, lag(v, {month}) over w as last_month from a window w as (partition by symbol order by day)),
    c as (select *, (v - last_week) / nullif(last_week, 0) as wow, (v - last_month) / nullif(last_month, 0) as mom from b),
    d as (select *, avg(wow) over w as wm, avg(mom) over w as mm from c window w as (partition by symbol order by day rows 7 preceding))
    select symbol, day, cast({value} as double) as "{value}", last_week, last_month, wow, mom, round(wm, 9) as wow_ma, round(mm, 9) as mom_ma
    from d where wow is not null and mom is not null
    {"qualify row_number() over (partition by symbol order by day desc) <= 7" if last else ""}"""


@report("j27_trend_unit_supply", sql("units", _trend_sql("units", "units", False, True)))
def _(t):
    return rnd(T.trend(I.unit_supply(events(t), ORDERS_START, ORDERS_AS_OF), ["symbol"], "day", "units"), 9, "wow_ma", "mom_ma")


@report("j27_trend_mint_volume", sql("iss order_days", """,
    x as (select symbol, day, sum(amount) as a from iss where evt_type = 'Issue' group by all),
    mints as (select s.symbol, d.day, coalesce(x.a, 0) as amount from (select distinct symbol from iss) s cross join order_days d
              left join x on x.day = d.day and x.symbol = s.symbol)""" + _trend_sql("mints", "amount", True, False).lstrip()))
def _(t):
    mv = I.mint_volume(events(t), ORDERS_START, ORDERS_AS_OF).drop("av")
    return rnd(T.trend(mv, ["symbol"], "day", "amount", smooth_first=True, last_n=None), 9, "wow_ma", "mom_ma")


@report("j27_trend_revenue", sql("revc", _trend_sql("revc", "revenue", False, False)))
def _(t):
    out = T.trend(constant_revenue(t).select("symbol", "day", "revenue"), ["symbol"], "day", "revenue", last_n=None)
    return rnd(out, 9, "wow_ma", "mom_ma")


@report("j27_trend_trading_volume", sql("vol", ", vols as (select product as symbol, day, usd_volume from vol)" + _trend_sql("vols", "usd_volume", True, False).lstrip()))
def _(t):
    v = volume(t).select(F.col("product").alias("symbol"), "day", "usd_volume")
    return rnd(T.trend(v, ["symbol"], "day", "usd_volume", smooth_first=True, last_n=None), 9, "wow_ma", "mom_ma")


@report("j27_trend_holders", sql("daily_bal event_days", """,
    tk as (select distinct token from daily_bal where balance > 0),
    counts as (select tk.token as symbol, d.day, count(distinct b.holder) as holders
               from tk cross join event_days d left join daily_bal b on b.token = tk.token and b.day = d.day and b.balance > 0 group by all)"""
    + _trend_sql("counts", "holders", False, True).lstrip()))
def _(t):
    counts = L.holder_count(holder_changes(t), EVENTS_START, EVENTS_AS_OF).withColumnRenamed("token", "symbol").withColumn("holders", F.col("holders").cast("double"))
    return rnd(T.trend(counts, ["symbol"], "day", "holders"), 9, "wow_ma", "mom_ma")


@report("j28_step_series", sql("ev event_days", """,
    c as (select pool as product, day, arg_max(value, event_id) as cap from ev where event_type = 'click' group by all),
    n as (select *, lead(day, 1, date '2024-02-01') over (partition by product order by day) as nxt from c)
    select product, d.day, cast(cap as double) as cap from n join event_days d on d.day >= n.day and d.day < n.nxt"""))
def _(t):
    caps = t.of_type("click").select(F.col("pool").alias("product"), "day", "event_id", F.col("value").alias("cap"))
    return T.step_series(caps, ["product"], "day", "cap", ["event_id"], EVENTS_AS_OF)


@report("j29_reward_earnings", sql("ev event_prices", """,
    d as (select day, sum(value) as amount from ev where event_type in ('purchase', 'signup') group by day),
    j as (select d.day, cast(amount as double) as amount, cast(amount as double) * cast(price as double) as usd
          from d join event_prices p on p.day = d.day and p.symbol = 'P0')
    select day, amount, usd, round(sum(usd) over (order by day), 4) as cum_usd from j"""))
def _(t):
    parts = [t.of_type(k).select("day", F.col("value").alias("amount")) for k in ("purchase", "signup")]
    return rnd(R.reward_earnings(parts, t.event_prices.where("symbol = 'P0'")), 4, "cum_usd")


define_view("costs", "ord lines base_prices", """
    select o.day, 'cost - ' || l_returnflag as detail,
           -sum(cast((o_custkey + 1) * 1000000000 * (21000 + o_orderkey) as double) / 1e18 * cast(price as double)) as amount
    from ord o join lineitem on l_orderkey = o_orderkey join base_prices b on b.minute = o.ts and b.symbol = 'B0' group by all""")
define_view("revlines", "revc", """
    select day, 'revenue - streaming' as detail, sum(streaming) as amount from revc group by day having sum(streaming) is not null
    union all select day, 'revenue - mint_redeem', sum(mint_redeem) from revc group by day having sum(mint_redeem) is not null""")


def costs(t: Tables):
    tags = [t.raw("lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tx_hash"), F.col("l_returnflag").alias("kind"))]
    txs = t.orders.select(
        "tx_hash", F.col("ts").alias("minute"), "day",
        ((F.col("o_custkey") + 1) * 1000000000).cast("decimal(18,0)").alias("gas_price"), (F.col("o_orderkey") + 21000).cast("decimal(12,0)").alias("gas_used"),
    )
    return R.tx_costs(tags, txs, t.base_prices.where("symbol = 'B0'"))


def revlines(t: Tables):
    return R.revenue_lines(constant_revenue(t)).where(F.col("amount").isNotNull())


@report("j30_tx_costs", sql("costs", "select day, detail, round(amount, 6) as amount from costs"))
def _(t):
    return rnd(costs(t), 6, "amount")


@report("j30_pnl_breakdown", sql("costs revlines", """
    select day, detail, round(amount, 4) as amount from costs union all select day, detail, round(amount, 4) from revlines"""))
def _(t):
    return rnd(R.pnl(revlines(t), costs(t)), 4, "amount")


PNL = """
    , r as (select day, sum(amount) as revenue from revlines group by day), c as (select day, sum(amount) as cost from costs group by day),
    d as (select coalesce(r.day, c.day) as day, coalesce(revenue, 0) as revenue, coalesce(cost, 0) as cost from r full join c on r.day = c.day)"""


@report("j30_pnl_daily", sql("costs revlines", PNL + """
    select day, round(revenue, 4) as revenue, round(cost, 4) as cost, round(revenue + cost, 4) as profit from d"""))
def _(t):
    return rnd(R.pnl(revlines(t), costs(t), "daily"), 4, "revenue", "cost", "profit")


@report("j30_pnl_cumulative", sql("costs revlines", PNL + """
    select day, round(sum(revenue) over (order by day), 1) as revenue, round(sum(abs(cost)) over (order by day), 1) as cost,
           round(sum(revenue + cost) over (order by day), 1) as profit from d"""))
def _(t):
    return rnd(R.pnl(revlines(t), costs(t), "cumulative"), 1, "revenue", "cost", "profit")


def _paired_sql(at: str) -> str:
    return sql("transfers", f""",
    x as (select *, date_trunc('minute', ts) as minute from transfers where token in ('P0', 'P1')),
    p as (select a.tx_hash, a.to_addr as pool, a.token as ta, cast(a.value as double) as va, cast(b.value as double) as vb
          from x a join x b on a.tx_hash = b.tx_hash and a.to_addr = b.from_addr and a.token <> b.token),
    m as (select pool, tx_hash, min({at}) as {at} from (select to_addr as pool, tx_hash, {at} from x union all select from_addr, tx_hash, {at} from x) group by all)
    select m.{at}, round(avg(case when ta = 'P0' then va / vb else vb / va end), 6) as price, count(*) as pairs
    from p join m on m.pool = p.pool and m.tx_hash = p.tx_hash group by m.{at}""")


@report("j31_paired_transfer_price", _paired_sql("day"))
def _(t):
    return rnd(P.paired_transfer_price(t.transfers, "P0", "P1"), 6, "price")


@report("j31_paired_transfer_price_minute", _paired_sql("minute"))
def _(t):
    rows = t.transfers.withColumn("minute", F.date_trunc("minute", "ts"))
    return rnd(P.paired_transfer_price(rows, "P0", "P1", "minute"), 6, "price")


@report("j32_revenue_split", sql("revc", """
    select symbol, day, streaming, mint_redeem, revenue, round(sum(streaming) over w, 1) as cum_streaming,
           round(sum(mint_redeem) over w, 1) as cum_mint_redeem, round(sum(revenue) over w, 1) as cum_revenue
    from revc window w as (partition by symbol order by day rows unbounded preceding)"""))
def _(t):
    return rnd(R.revenue_split(constant_revenue(t)), 1, "cum_streaming", "cum_mint_redeem", "cum_revenue")
