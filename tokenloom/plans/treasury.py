"""Treasury, vesting and staking reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import staking as S
from ..operators import treasury as T
from ..operators.liquidity import staked_share
from ..operators.timeseries import closing, spine
from ..sources.canonical import EVENTS_AS_OF, EVENTS_START, Tables
from .registry import define_view, report, rnd, sql

POOLS = [f"0x{n:08d}" for n in range(1, 31)]  # staking contracts / team wallets
IN_POOLS = "(" + ", ".join(f"'{p}'" for p in POOLS) + ")"

define_view("wallets", "tags", "select distinct address from tags where type = 'contract'")
define_view("osigned", "order_ledger", """
    select token, day, to_addr as holder, value as amount, from_addr from order_ledger union all select token, day, from_addr, -value, from_addr from order_ledger""")
define_view("wchg", "osigned wallets", "select token, holder, day, sum(amount) as change from osigned where holder in (select address from wallets) group by all")


def wallets(t: Tables):
    return t.labels.where("type = 'contract'").select("address")


def changes(t: Tables):
    return T.wallet_changes(t.order_ledger, wallets(t))


def _over_time(unit: str) -> str:
    return sql("wchg order_days prices", f"""
    , c as (select token, day, sum(change) as c from wchg where day <= date '2000-12-31' group by all),
    b as (select token, day, sum(c) over (partition by token order by day) as balance, lead(day, 1, date '2001-01-01') over (partition by token order by day) as nxt from c),
    a as (select b.token, d.day, balance from b join order_days d on d.day >= b.day and d.day < nxt)
    select cast(date_trunc('{unit}', a.day) as date) as period, a.token, round(avg(cast(balance as double) * coalesce(cast(price as double), 0)), 4) as avg_usd_value
    from a left join prices p on p.symbol = a.token and p.day = a.day where a.day >= date '1996-01-01' group by all""")


@report("n01_treasury_over_time_week", _over_time("week"))
def _(t):
    return rnd(T.treasury_over_time(changes(t), t.prices, "week", "1996-01-01", "2000-12-31"), 4, "avg_usd_value")


@report("n01_treasury_over_time_month", _over_time("month"))
def _(t):
    return rnd(T.treasury_over_time(changes(t), t.prices, "month", "1996-01-01", "2000-12-31"), 4, "avg_usd_value")


def _current(by: str) -> str:
    return sql("wchg prices", f"""
    select {by}, cast(balance as double) as balance, cast(balance as double) * coalesce(cast(price as double), 0) as usd_value
    from (select {by}, sum(change) as balance from wchg where day <= date '2000-12-31' group by all) b
    left join prices p on p.symbol = b.token and p.day = date '2000-12-31'""")


@report("n02_treasury_current", _current("token"))
def _(t):
    return T.treasury_current(changes(t), t.prices, "2000-12-31")


@report("n02_treasury_current_by_account", _current("holder, token"))
def _(t):
    return T.treasury_current(changes(t), t.prices, "2000-12-31", by=("holder", "token"))


@report("n03_flows_weekly", sql("osigned wallets prices", """,
    r as (select token, day, holder, amount > 0 as inward, sum(amount) as a from osigned where holder in (select address from wallets) group by all),
    w as (select r.token, cast(date_trunc('week', r.day) as date) as week, avg(cast(price as double)) as avg_price,
                 coalesce(sum(a) filter (where inward), 0) as inflow, coalesce(sum(a) filter (where not inward), 0) as outflow,
                 coalesce(sum(cast(a as double) * coalesce(cast(price as double), 0)) filter (where inward), 0) as inflow_usd,
                 coalesce(sum(cast(a as double) * coalesce(cast(price as double), 0)) filter (where not inward), 0) as outflow_usd
          from r left join prices p on p.symbol = r.token and p.day = r.day group by all)
    select token, week, round(avg_price, 6) as avg_price, cast(inflow as double) as inflow, cast(outflow as double) as outflow, round(inflow_usd, 4) as inflow_usd,
           round(outflow_usd, 4) as outflow_usd, round(avg_price * cast(sum(inflow + outflow) over (partition by token order by week) as double), 3) as balance_usd from w"""))
def _(t):
    out = T.flows_weekly(t.order_ledger, wallets(t), t.prices)
    return rnd(rnd(rnd(out, 4, "inflow_usd", "outflow_usd"), 6, "avg_price"), 3, "balance_usd")


@report("n04_flows_by_recipient", sql("order_ledger wallets prices tags", f""",
    r as (select token, day, from_addr, to_addr as recipient, sum(value) as a from order_ledger where from_addr in (select address from wallets) group by all),
    m as (select cast(date_trunc('month', r.day) as date) as month, recipient, r.token, avg(cast(price as double)) as avg_price, cast(sum(a) as double) as amount,
                 sum(cast(a as double) * coalesce(cast(price as double), 0)) as amount_usd
          from r left join prices p on p.symbol = r.token and p.day = r.day group by all)
    select month, recipient, token, round(avg_price, 6) as avg_price, amount, round(amount_usd, 4) as amount_usd,
           case when recipient in {IN_POOLS} then 'Contributor Rewards' else coalesce(x.alias, 'unknown') end as category
    from m left join (select address, min(name) as alias from tags group by address) x on x.address = m.recipient"""))
def _(t):
    out = T.flows_by_recipient(t.order_ledger, wallets(t), t.prices, t.labels.select("address", F.col("name").alias("alias")), POOLS)
    return rnd(rnd(out, 4, "amount_usd"), 6, "avg_price")


@report("n05_backing", sql("osigned prices order_ledger", f""",
    c as (select holder, token, cast(sum(amount) as double) as balance from osigned where holder in {IN_POOLS} and day <= date '2000-12-31' group by all),
    v as (select c.*, balance * coalesce(cast(price as double), 0) as usd from c left join prices p on p.symbol = c.token and p.day = date '2000-12-31'),
    x as (select coalesce(sum(usd) filter (where holder = '0x00000004' and token = 'P1'), 0) as usd_P1, coalesce(sum(usd) filter (where holder = '0x00000004' and token = 'P2'), 0) as usd_P2,
                 coalesce(sum(balance) filter (where token = 'P0' and holder in ('0x00000005', '0x00000007')), 0) as locked from v),
    s as (select cast(sum(case when from_addr = '0x00000000' then value when to_addr = '0x00000000' then -value end) as double) as total_supply from order_ledger where token = 'P0')
    select usd_P1, usd_P2, locked, total_supply, total_supply - locked as circulating, (usd_P1 + usd_P2) / nullif(total_supply, 0) as usd_per_total,
           (usd_P1 + usd_P2) / nullif(total_supply - locked, 0) as usd_per_circulating from x cross join s"""))
def _(t):
    mine = t.spark.createDataFrame([(p,) for p in POOLS], "address string")
    current = T.treasury_current(T.wallet_changes(t.order_ledger, mine), t.prices, "2000-12-31", by=("holder", "token"))
    return T.backing(current, t.order_ledger, "P0", ["P1", "P2"], "0x00000004", ["0x00000005", "0x00000007"])


# fixed values: daily grant per period
GRANTS = [("2024-01-01", "2024-01-10", "6506.8493"), ("2024-01-11", "2024-01-20", "3904.1096"), ("2024-01-21", "2024-01-31", "2602.7397")]


@report("n06_vesting", sql("transfers event_days", f""",
    g as (select day, cast(case when day <= date '2024-01-10' then 6506.8493 when day <= date '2024-01-20' then 3904.1096 else 2602.7397 end as decimal(18,4)) as d from event_days),
    c as (select day, sum(value) as c from transfers where from_addr in {IN_POOLS} and token = 'P1' group by day),
    r as (select g.day, sum(d) over (order by g.day) as granted, sum(coalesce(c, 0)) over (order by g.day) as claimed from g left join c on c.day = g.day)
    select day, cast(granted as double) as granted, cast(claimed as double) as claimed, cast(granted - claimed as double) as available from r"""))
def _(t):
    rows = t.spark.createDataFrame(GRANTS, "begin string, finish string, daily string")
    schedule = rows.select(F.col("begin").cast("date").alias("begin"), F.col("finish").cast("date").alias("finish"), F.col("daily").cast("decimal(18,4)").alias("daily"))
    claims = t.transfers.where(F.col("from_addr").isin(*POOLS) & (F.col("token") == "P1")).select("day", F.col("value").alias("amount"))
    return T.vesting(schedule, claims, EVENTS_START, EVENTS_AS_OF)


# fixed values: daily rewards; the second range overlaps the first on purpose
SCHEDULE = [("2024-01-02", "2024-01-12", 3864), ("2024-01-10", "2024-01-22", 2500), ("2024-01-22", "2024-01-31", 1250)]
define_view("staked", "signed event_days", f"""
    select e.day, sum(coalesce(m, 0)) over (order by e.day) as minted, sum(coalesce(s, 0)) over (order by e.day) as balance
    from event_days e left join (select day, -sum(amount) filter (where holder = '0x00000000') as m, sum(amount) filter (where holder in {IN_POOLS}) as s
                                 from signed where token = 'P2' group by day) x on x.day = e.day""")
define_view("apr", "staked event_prices ev", """
    with r as (select day, arg_max(k, event_id) as base from ev where event_type = 'click' and pool = 'P2' group by day),
    j as (select s.day, cast(balance as double) as balance, cast(balance - lag(balance) over (order by s.day) as double) as change, cast(a.price as double) as reward_price,
                 cast(b.price as double) as base_price, cast(base as double) as base_reserve, cast(minted as double) as lp_total,
                 case when s.day >= date '2024-01-02' and s.day < date '2024-01-12' then 3864.0::double when s.day >= date '2024-01-10' and s.day < date '2024-01-22' then 2500.0::double
                      when s.day >= date '2024-01-22' and s.day < date '2024-01-31' then 1250.0::double end as daily_reward
          from staked s left join event_prices a on a.symbol = 'P3' and a.day = s.day left join event_prices b on b.symbol = 'P4' and b.day = s.day left join r on r.day = s.day)
    select *, base_price * (base_reserve * 2) as tvl, base_price * (base_reserve * 2) / nullif(lp_total, 0) as lp_usd,
           reward_price * daily_reward / nullif(balance * (base_price * (base_reserve * 2) / nullif(lp_total, 0)), 0) * 365 * 100 as apr,
           daily_reward / nullif(balance, 0) as reward_per_lp from j""")
define_view("smoves", "transfers", f"""
    select day, from_addr as address, value as amount from transfers where token = 'P2' and to_addr in {IN_POOLS}
    union all select day, to_addr, -value from transfers where token = 'P2' and from_addr in {IN_POOLS}""")
define_view("srew", "smoves apr event_days", """
    with c as (select address, day, sum(amount) as c from smoves group by all),
    b as (select address, day, sum(c) over (partition by address order by day) as balance,
                 lead(day, 1, date '2024-02-01') over (partition by address order by day) as nxt from c),
    a as (select b.address, d.day, b.balance, reward_per_lp from b join event_days d on d.day >= b.day and d.day < nxt join apr on apr.day = d.day)
    select address, arg_max(balance, day) as balance, count(*) filter (where balance > 0) as days_earned,
           sum(cast(balance as double) * coalesce(reward_per_lp, 0)) as rewards_earned from a group by address""")
define_view("sbeh", "srew transfers", f"""
    with c as (select to_addr as address, min(ts) as f, -sum(value) as claimed from transfers where token = 'P3' and from_addr in {IN_POOLS} group by 1),
    m as (select from_addr as address, sum(value) as moved from transfers join c on c.address = from_addr where token = 'P3' and ts >= f group by 1)
    select r.*, coalesce(claimed, 0) as claimed, coalesce(moved, 0) as moved, case when coalesce(moved, 0) = 0 then 'Holder' else 'Seller' end as account_type,
           row_number() over (order by balance desc, r.address) as lp_rank
    from srew r left join c on c.address = r.address left join m on m.address = r.address""")


def apr(t: Tables):
    share = staked_share(t.transfers, "P2", POOLS, EVENTS_START, EVENTS_AS_OF)
    clicks = t.of_type("click").where("pool = 'P2'")
    res = closing(clicks, ["day"], ["k"], ["event_id"]).withColumnRenamed("k", "base")
    sched = S.reward_schedule(spine(t.spark, EVENTS_START, EVENTS_AS_OF), SCHEDULE)
    px = t.event_prices
    return S.staking_apr(share.select("day", F.col("staked").alias("balance")), px.where("symbol = 'P3'"), px.where("symbol = 'P4'"), res, share, sched)


def rewards(t: Tables):
    return S.staker_rewards(S.stake_moves(t.transfers, POOLS, "P2"), apr(t).select("day", "reward_per_lp"), EVENTS_AS_OF)


def behaviour(t: Tables):
    return S.staker_behaviour(rewards(t), t.transfers, POOLS, "P3")


@report("n07_staking_apr", sql("apr", "select * from apr"))
def _(t):
    return apr(t)


@report("n08_staker_rewards", sql("srew", "select address, cast(balance as double) as balance, days_earned, round(rewards_earned, 5) as rewards_earned from srew"))
def _(t):
    return rnd(rewards(t), 5, "rewards_earned")


@report("n09_staker_behaviour", sql("sbeh", """
    select address, cast(balance as double) as balance, days_earned, round(rewards_earned, 5) as rewards_earned, cast(claimed as double) as claimed,
           cast(moved as double) as moved, account_type, lp_rank from sbeh"""))
def _(t):
    return rnd(behaviour(t), 5, "rewards_earned")


@report("n09_staker_summary", sql("sbeh", """,
    x as (select *, rewards_earned + cast(claimed as double) as due from sbeh)
    select cast(sum(case when lp_rank <= 10 then balance else 0 end) as double) as top_balance, cast(sum(balance) as double) as total_staked, round(sum(due), 5) as outstanding,
           round(sum(case when account_type = 'Holder' then due else 0 end), 5) as outstanding_holders, round(sum(case when account_type = 'Seller' then due else 0 end), 5) as outstanding_sellers,
           cast(sum(case when lp_rank <= 10 then balance else 0 end) as double) * 100 / nullif(cast(sum(balance) as double), 0) as top_share from x"""))
def _(t):
    return rnd(S.staker_summary(behaviour(t)), 5, "outstanding", "outstanding_holders", "outstanding_sellers")


@report("n09_top_stakes", sql("srew", """
    select cast(sum(balance) filter (where r <= 10) as double) as top_balance, cast(sum(balance) as double) as total,
           cast(sum(balance) filter (where r <= 10) as double) / nullif(cast(sum(balance) as double), 0) as top_share
    from (select balance, row_number() over (order by balance desc, address) as r from srew)"""))
def _(t):
    return S.top_stakes(rewards(t))
