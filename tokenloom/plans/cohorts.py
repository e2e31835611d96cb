"""Cohort, retention and promotion reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import ledger as L
from ..operators import liquidity as Q
from ..operators import promo as P
from ..sources.canonical import EVENTS_AS_OF, ORDERS_AS_OF, Tables
from .registry import define_view, report, sql

BAND = "case when {x} >= 250 then '250+' when {x} >= 50 then '50-249' when {x} >= 10 then '10-49' else '<10' end"


def _base_views(p: str, moves: str, days: str) -> None:
    """Views of the source's dense pipeline: moves without bots, cohorts, day grid, maturity cut."""
    define_view(f"{p}good", f"{p}moves", f"""
        select * from {p}moves m where not exists (select 1 from (
          select token, holder, day from {p}moves group by all having sum(amount) <= 1e-14 and count(*) >= 2) b
          where b.token = m.token and b.holder = m.holder)""")
    define_view(f"{p}coh", f"{p}good", f"""
        select token, holder, min(day) as start_dt, strftime(min(day), '%b %Y') as cohort, {BAND.format(x='max(r)')} as exposure
        from (select *, sum(amount) over (partition by token, holder order by ts) as r from {p}good) group by token, holder""")
    define_view(f"{p}grid", f"{p}coh {p}good {days}", f"""
        select c.token, c.holder, cohort, exposure, d.day as dt, date_diff('day', start_dt, d.day) + 1 as day,
               coalesce(a.amount, 0) as amount, sum(coalesce(a.amount, 0)) over (partition by c.token, c.holder order by d.day) as running_amount
        from {p}coh c join {days} d on d.day >= c.start_dt
        left join (select token, holder, day, sum(amount) as amount from {p}good group by all) a on a.token = c.token and a.holder = c.holder and a.day = d.day""")
    define_view(f"{p}base", f"{p}grid", f"""
        select g.*, case when running_amount > 0 then 1 else 0 end as retained from {p}grid g
        join (select token, cohort, round(max(day) * 0.75) as keep from {p}grid group by all) k on k.token = g.token and k.cohort = g.cohort
        where k.keep >= g.day""")


define_view("emoves", "signed ev tags", """
    select * from (
      select token, holder, day, ts, tx_hash, amount, 'transfer' as kind from signed
      union all select pool, address, day, ts, tx_hash, value, 'pool_add' from ev where event_type = 'purchase'
      union all select pool, address, day, ts, tx_hash, -value, 'pool_remove' from ev where event_type = 'click') x
    where holder <> '0x00000000' and holder not in (select address from tags where type = 'contract')""")
define_view("omoves", "order_ledger", """
    select 'ALL' as token, holder, day, ts, tx_hash, amount from (
      select to_addr as holder, day, ts, tx_hash, value as amount from order_ledger
      union all select from_addr, day, ts, tx_hash, -value from order_ledger) where holder <> '0x00000000'""")
_base_views("e", "emoves", "event_days")
_base_views("o", "omoves", "order_days")


def event_moves(t: Tables):
    def lp(kind):
        return t.of_type(kind).select(F.col("pool").alias("token"), "day", "ts", "tx_hash", F.col("address").alias("holder"), F.col("value").alias("amount"))

    return C.movements(t.transfers, [(lp("purchase"), 1, "pool_add"), (lp("click"), -1, "pool_remove")], t.labels)


def order_intervals(t: Tables, frac: float | None = 0.75):
    one = t.order_ledger.withColumn("token", F.lit("ALL"))
    moves = L.signed_ledger(one, ["ts", "tx_hash"]).where(F.col("holder") != L.ZERO)
    return C.exposure_intervals(moves, ORDERS_AS_OF, frac)


@report("k01_movements", sql("emoves", "select token, holder, day, ts, tx_hash, cast(amount as double) as amount, kind from emoves"))
def _(t):
    return event_moves(t)


@report("k02_cohorts", sql("ocoh", "select * from ocoh"))
def _(t):
    one = t.order_ledger.withColumn("token", F.lit("ALL"))
    return C.cohorts(L.signed_ledger(one, ["ts", "tx_hash"]).where(F.col("holder") != L.ZERO), drop_bots=True)


BASE_COLS = """token, holder, cohort, exposure, dt, day, cast(amount as double) as amount, cast(running_amount as double) as running_amount"""


@report("k03_user_base", sql("ebase", f"select {BASE_COLS}, cast(retained as bigint) as retained from ebase"))
def _(t):
    return C.user_base(event_moves(t), EVENTS_AS_OF)


@report("k04_maturity_cut_full", sql("egrid", f"select {BASE_COLS}, cast(case when running_amount > 0 then 1 else 0 end as bigint) as retained from egrid"))
def _(t):
    return C.user_base(C.without_bots(event_moves(t)), EVENTS_AS_OF, frac=1.0)


@report("k05_retention", sql("obase", "select token, cohort, day, cast(sum(retained) as double) / count(*) as retention from obase group by all"))
def _(t):
    return C.retention(order_intervals(t))


@report("k06_retained_week", sql("obase", """,
    w as (select token, cohort, day, case when sum(retained) over (partition by holder order by dt rows 7 preceding) >= 1 then 1 else 0 end as kept from obase)
    select token, cohort, day, cast(sum(kept) as double) / count(*) as retention from w group by all"""))
def _(t):
    return C.retained_week(order_intervals(t))


@report("k07_net_unit_retention", sql("obase", """,
    d as (select token, day, sum(amount) as amount from obase group by all)
    select token, day, cast(amount as double) as amount, cast(sum(amount) over w as double) as running_amount,
           cast(sum(amount) over w as double) / cast(first_value(amount) over w as double) as net_retention
    from d window w as (partition by token order by day)"""))
def _(t):
    return C.net_unit_retention(order_intervals(t))


@report("k08_holders_by_exposure", sql("obase", "select token, exposure, dt, count(distinct holder) as addresses from obase where retained = 1 group by all"))
def _(t):
    return C.holders_by(order_intervals(t), "exposure")


@report("k08_holders_by_cohort", sql("obase", "select token, cohort, dt, count(distinct holder) as addresses from obase where retained = 1 group by all"))
def _(t):
    return C.holders_by(order_intervals(t), "cohort")


def _aum_sql(by: str) -> str:
    return sql("obase prices", f"""
    select b.token, b.{by}, b.dt, cast(sum(running_amount) as double) as units, cast(sum(running_amount) as double) * cast(any_value(p.price) as double) as aum
    from obase b left join prices p on p.day = b.dt and p.symbol = 'P0' where retained = 1 group by all""")


def _all_price(t: Tables):
    return t.prices.where("symbol = 'P0'").withColumn("symbol", F.lit("ALL"))


@report("k09_aum_by_cohort", _aum_sql("cohort"))
def _(t):
    return C.aum_by(order_intervals(t), _all_price(t), "cohort")


@report("k09_aum_by_exposure", _aum_sql("exposure"))
def _(t):
    return C.aum_by(order_intervals(t), _all_price(t), "exposure")


@report("k10_holders_growth", sql("obase", "select token, exposure, cohort, min(dt) as min_dt, count(distinct holder) as addresses from obase group by all"))
def _(t):
    return C.holders_growth(order_intervals(t))


@report("k11_repeat_buyers", sql("obase", """,
    a as (select token, holder, dt, running_amount - lag(running_amount) over (partition by holder order by dt) as net_new from obase),
    b as (select token, dt, sum(case when net_new is null or net_new > 0 then 1 else 0 end) over (partition by holder order by dt) as n from a)
    select token, case when n < 5 then cast(n as varchar) else '5+' end as buys, dt, count(*) as holders from b group by all"""))
def _(t):
    return C.repeat_buyers(order_intervals(t))


@report("k12_whale_retention", sql("obase", """
    select token, cohort, day, cast(sum(case when running_amount >= 250 then 1 else 0 end) as double) / count(*) as retention
    from obase where exposure = '250+' group by all"""))
def _(t):
    return C.retention(order_intervals(t).where("exposure = '250+'"), threshold=250)


@report("k12_band_share", sql("obase", """,
    g as (select token, exposure, dt, count(distinct holder) as addresses, sum(running_amount) as units from obase group by all)
    select token, exposure, dt, addresses, cast(units as double) as units, cast(addresses as double) / sum(addresses) over (partition by dt) as address_share,
           cast(units as double) / nullif(cast(sum(units) over (partition by dt) as double), 0) as unit_share from g"""))
def _(t):
    return C.band_share(order_intervals(t))


@report("k13_retention_by_exposure", sql("obase", "select token, exposure, day, cast(sum(retained) as double) / count(*) as retention from obase group by all"))
def _(t):
    return C.retention(order_intervals(t), by="exposure")


@report("k14_holding_times", sql("ord", """,
    c as (select wallet as holder, day, sum(case when o_orderstatus = 'O' then -amount else amount end) as change from ord group by all),
    b as (select holder, day, change, sum(change) over (partition by holder order by day) as balance, min(day) over (partition by holder) as a from c),
    p as (select holder, a, arg_max(balance, day) as last_balance, coalesce(max(day) filter (where change <> 0), a) as z from b group by holder, a),
    s as (select least(date_diff('day', a, case when last_balance > 0 then date '2001-08-01' else z end) // 365 + 1, 6) as seq from p)
    select seq, case when seq > 5 then '5+ months' else cast(seq - 1 as varchar) || '-' || cast(seq as varchar) || ' months' end as holding_time, count(*) as users
    from s group by all"""))
def _(t):
    # order data spans years, so the bands are 365 days wide here
    change = F.when(F.col("o_orderstatus") == "O", -F.col("amount")).otherwise(F.col("amount"))
    daily = t.orders.groupBy(F.col("wallet").alias("holder"), "day").agg(F.sum(change).alias("change"))
    return C.holding_times(daily, ORDERS_AS_OF, width=365)


@report("k15_trade_frequency", sql("ev", """,
    n as (select address, count(*) as n from ev where event_type in ('view', 'click', 'purchase') group by address)
    select case when n >= 100 then '100+' when n >= 50 then '50-100' when n >= 25 then '25-50' when n >= 10 then '10-25' when n >= 5 then '5-10' else '0-5' end as trades,
           count(*) as users from n group by all"""))
def _(t):
    return C.trade_frequency([t.of_type(k).select(F.col("address").alias("holder")) for k in ("view", "click", "purchase")])


define_view("members", "tags", "select distinct address from tags where name in ('BUILDING', 'MACHINERY')")


def members(t: Tables):
    return t.labels.where(F.col("name").isin("BUILDING", "MACHINERY")).select("address")


@report("k16_pre_post_exposure", sql("daily_bal members", """,
    d as (select day, sum(balance) as e from daily_bal where token = 'P0' and balance > 0 and holder in (select address from members) group by day)
    select case when day < date '2024-01-15' then 'pre' else 'post' end as period, cast(sum(e) as double) / count(*) as avg_daily_exposure from d group by all"""))
def _(t):
    iv = L.balance_intervals(L.daily_change(L.signed_ledger(t.transfers)).where("token = 'P0'"), EVENTS_AS_OF)
    return C.pre_post_exposure(iv, members(t), "2024-01-15", EVENTS_AS_OF)


@report("k16_new_holders", sql("daily_bal members", """,
    b as (select * from daily_bal where token = 'P0' and holder in (select address from members))
    select day, cast(sum(balance) as double) as total_balance, count(distinct holder) as holders from b
    where day >= date '2024-01-05' and balance > 0 and holder not in (select holder from b where day < date '2024-01-05' and balance > 0) group by day"""))
def _(t):
    iv = L.balance_intervals(L.daily_change(L.signed_ledger(t.transfers)).where("token = 'P0'"), EVENTS_AS_OF)
    return C.new_holders(iv, members(t), "2024-01-05", EVENTS_AS_OF)


# promotion: everything minted between the 3rd and the 20th counts as sold by the promoter
PROMO = (L.ZERO, "P1", "2024-01-03", "2024-01-20")
define_view("bought", "transfers", """
    select to_addr as holder, sum(value) as bought from transfers
    where from_addr = '0x00000000' and token = 'P1' and day >= date '2024-01-03' and day < date '2024-01-20' group by 1""")
define_view("outs", "transfers bought", """
    select from_addr as holder, day, ts, tx_hash, value as amount, cast(round(cast(value as double)) as bigint) as o from transfers
    where token = 'P1' and day >= date '2024-01-20' and from_addr in (select holder from bought)""")
define_view("charged", "outs bought", """
    select * from (select holder, day, tx_hash, bought, out, case when r <= bought then out else greatest(bought - r + out, 0) end as charged from (
      select x.holder, day, tx_hash, cast(round(cast(b.bought as double)) as bigint) as bought, o as out,
             sum(o) over (partition by x.holder order by ts, tx_hash rows unbounded preceding) as r
      from outs x join bought b on b.holder = x.holder)) where charged <> 0""")


def bought(t: Tables):
    return P.bought_in_window(t.transfers, *PROMO)


def outs(t: Tables):
    rows = t.transfers.where((F.col("token") == "P1") & (F.col("day") >= F.lit("2024-01-20").cast("date")))
    out = rows.select(F.col("from_addr").alias("holder"), "day", "ts", "tx_hash", F.col("value").alias("amount"))
    return out.join(bought(t).select("holder"), "holder", "left_semi")


def reward_txs(t: Tables):
    return t.ev.where("value > 100").select("tx_hash")


@report("k17_promo_summary", sql("transfers bought ev", """
    select * from (select count(distinct to_addr) as airdrop_addresses, cast(sum(value) as double) as airdropped from transfers
                   where tx_hash in (select tx_hash from ev where value > 100) and from_addr <> '0x00000003')
    cross join (select count(*) as buyers, cast(sum(bought) as double) as bought from bought)"""))
def _(t):
    return P.promo_summary(t.transfers, reward_txs(t), "0x00000003", *PROMO)


@report("k18_buyer_segments", sql("signed bought lp_pos", """,
    w as (select holder, cast(sum(amount) as double) as amount from signed where token = 'P1' and day < date '2024-01-03' group by 1),
    l as (select holder, sum(position) as lp from lp_pos group by 1),
    r as (select b.holder, cast(round(coalesce(w.amount, 0) + coalesce(lp, 0)) as bigint) as total_amount, cast(round(coalesce(w.amount, 0)) as bigint) as in_wallet,
                 cast(round(coalesce(lp, 0)) as bigint) as in_pools, cast(round(cast(bought as double)) as bigint) as bought
          from bought b left join w on w.holder = b.holder left join l on l.holder = b.holder)
    select *, count(*) filter (where total_amount >= 25) over () as big_holders, count(*) filter (where total_amount < 25 and total_amount > 0) over () as small_holders,
           count(*) filter (where total_amount = 0) over () as new_holders, cast(sum(case when total_amount = 0 then bought else 0 end) over () as bigint) as new_bought from r"""))
def _(t):
    lp = Q.lp_share(t.transfers, "P2", "P1", "0x00000005", before="2024-01-03").select("holder", F.col("position").alias("amount"))
    return P.buyer_segments(bought(t), P.wallet_balance_before(t.transfers, "P1", "2024-01-03"), lp, big=25)


@report("k19_capped_outflow", sql("outs bought", """,
    p as (select holder, day, cast(round(cast(sum(amount) as double)) as bigint) as o from outs group by all),
    r as (select p.holder, day, o, cast(round(cast(b.bought as double)) as bigint) as bought, sum(o) over (partition by p.holder order by day) as run
          from p join bought b on b.holder = p.holder),
    d as (select day, cast(sum(case when run <= bought then o else greatest(bought - run + o, 0) end) as bigint) as charged from r group by day)
    select day, charged, cast(sum(charged) over (order by day) as bigint) as cum_charged,
           ((select sum(cast(round(cast(bought as double)) as bigint)) from bought) - sum(charged) over (order by day))::double
           / (select sum(cast(round(cast(bought as double)) as bigint)) from bought)::double as retention_rate from d"""))
def _(t):
    return P.capped_outflow_daily(bought(t), outs(t))


@report("k20_disposition", sql("charged ev", """,
    c as (select tx_hash, sum(charged) as c from charged group by 1),
    f as (select c, tx_hash in (select tx_hash from ev where event_type = 'view') as s, tx_hash in (select tx_hash from ev where event_type = 'signup') as k,
                 tx_hash in (select tx_hash from ev where event_type = 'purchase') as p from c),
    x as (select cast(sum(case when s then c else 0 end) as bigint) as sold, cast(sum(case when k then c else 0 end) as bigint) as staked,
                 cast(sum(case when p then c else 0 end) as bigint) as pooled, cast(sum(c) as bigint) as total from f)
    select *, total - sold - staked - pooled as other from x"""))
def _(t):
    c = P.capped_outflow_events(bought(t), outs(t))
    return P.disposition(c, *[t.of_type(k).select("tx_hash") for k in ("view", "signup", "purchase")])


@report("k20_capped_outflow_events", sql("charged", "select holder, day, tx_hash, bought, out, cast(charged as bigint) as charged from charged"))
def _(t):
    return P.capped_outflow_events(bought(t), outs(t))


@report("k21_follow_on", sql("transfers ev", """,
    r as (select distinct to_addr as a from transfers where tx_hash in (select tx_hash from ev where value > 100)),
    g as (select distinct tx_hash, token, to_addr, value from transfers where token in ('P0', 'P1', 'P3') and to_addr in (select a from r)
          and tx_hash in (select tx_hash from ev where event_type in ('view', 'click') and day >= date '2024-01-10'))
    select token, count(distinct to_addr) as buyers, cast(sum(value) as double) as amount, (select count(distinct to_addr) from g) as all_buyers from g group by token"""))
def _(t):
    rewarded = t.transfers.join(reward_txs(t).distinct(), "tx_hash", "left_semi").select(F.col("to_addr").alias("address"))
    swap_txs = t.swaps.where(F.col("day") >= F.lit("2024-01-10").cast("date")).select("tx_hash")
    return P.follow_on(t.transfers, rewarded, swap_txs, ["P0", "P1", "P3"])


@report("k22_promo_rewards", sql("ev event_prices", """,
    b as (select address as wallet, min(ts) as fb, max(ts) as lb, sum(value) as v, sum(value * k) as usd from ev where event_type = 'purchase' and ts >= timestamp '2024-01-26' group by 1),
    s as (select e.address as wallet, min(ts) as fs, sum(value) as v from ev e join b on b.wallet = e.address where event_type = 'view' and ts >= fb group by 1),
    j as (select b.wallet, cast(b.usd as double) as usd, cast(b.v as double) as bv, cast(s.v as double) as sv,
                 (epoch_us(fs)::double - epoch_us(lb)::double) / 86400e6 as held from b left join s on s.wallet = b.wallet),
    e as (select wallet, case when held is null or held >= 1 then usd else usd - usd * (sv / bv) end as eligible_usd from j)
    select wallet, eligible_usd, eligible_usd * 0.05::double as usd_reward,
           eligible_usd * 0.05::double / (select cast(sum(price) as double) / count(price) from event_prices where symbol = 'P0') as units_reward
    from e where eligible_usd >= 10"""))
def _(t):
    def side(kind):
        return t.of_type(kind).select(F.col("address").alias("wallet"), "ts", F.col("value").alias("volume"), (F.col("value") * F.col("k")).alias("usd"))

    return P.promo_rewards(side("purchase"), side("view"), t.event_prices.where("symbol = 'P0'"), "2024-01-26", hold_days=1)
