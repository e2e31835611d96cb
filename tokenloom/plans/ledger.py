"""Ledger, balance and holder reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitmaps as M
from ..operators import ledger as L
from ..operators.timeseries import expand_intervals
from ..session import scratch_path
from ..sources.canonical import EVENTS_AS_OF, EVENTS_START, Tables
from ..sources.sinks import write_bucketed
from ..streaming import balances as Z
from .registry import define_view, report, sql

TOKENS = ["P0", "P1", "P2", "P3", "P4"]

define_view("signed", "transfers", """
    select token, day, ts, tx_hash, to_addr as holder, value as amount from transfers
    union all select token, day, ts, tx_hash, from_addr, -value from transfers""")
define_view("changes", "signed", """
    select token, holder, day, sum(amount) as change from signed where holder <> '0x00000000' group by all""")
define_view("change_bal", "changes", """
    select token, holder, day, sum(change) over (partition by token, holder order by day) as balance,
           row_number() over (partition by token, holder order by day desc) as recency from changes""")
define_view("daily_bal", "change_bal event_days", """
    select b.token, b.holder, d.day, b.balance
    from (select *, lead(day, 1, date '2024-02-01') over (partition by token, holder order by day) as nxt from change_bal) b
    join event_days d on d.day >= b.day and d.day < b.nxt""")
define_view("latest_bal", "change_bal", "select token, holder, balance, day as last_day from change_bal where recency = 1")
define_view("matrix", "latest_bal tags", """
    select w.*, t.labels from (
      select holder, """ + ", ".join(
    f"coalesce(cast(round(cast(sum(balance) filter (where token = '{t}') as double)) as bigint), 0) as {t}" for t in TOKENS) + """
      from latest_bal group by holder having sum(balance) filter (where token = 'P0') >= 25) w
    left join (select address, string_agg(distinct name, '| ' order by name) as labels from tags group by address) t on t.address = w.holder""")
define_view("matrix_long", "matrix", " union all ".join(f"select holder, '{t}' as token, {t} as amount from matrix" for t in TOKENS))


def changes(t: Tables):
    return L.daily_change(L.signed_ledger(t.transfers))


@report("i01_signed_ledger", sql("signed", "select token, day, tx_hash, holder, cast(amount as double) as amount from signed"))
def _(t):
    return L.signed_ledger(t.transfers, ["tx_hash"])


@report("i02_daily_change", sql("changes", "select token, holder, day, cast(change as double) as change from changes"))
def _(t):
    return changes(t)


@report("i03_balance_on_change", sql("change_bal", "select token, holder, day, cast(balance as double) as balance, recency from change_bal"))
def _(t):
    return L.balance_on_change(changes(t))


DAILY = sql("daily_bal", "select token, holder, day, cast(balance as double) as balance from daily_bal")


@report("i04_balance_daily", DAILY)
def _(t):
    return L.balance_daily(changes(t), EVENTS_AS_OF)


@report("i04_balance_daily_incremental", DAILY)
def _(t):
    """A month taken in by two steps and late changes; each step reads its own days only."""
    store, change = scratch_path(t.spark, "balances"), changes(t)
    late = F.pmod(F.xxhash64("holder"), F.lit(7)) == 0
    Z.create(t.spark, store)
    Z.advance(change.where(~late | (F.col("day") > "2024-01-10")), store, "2024-01-15")
    Z.advance(change, store, EVENTS_AS_OF)
    Z.correct(change.where(late & (F.col("day") <= "2024-01-10")), store)
    return expand_intervals(Z.intervals(t.spark, store), "day", "next_day", "day")


def bucketed_changes(t: Tables):
    """Daily changes stored by holder; the reports below share its layout and shuffle nothing by holder."""
    return write_bucketed(changes(t), scratch_path(t.spark, "changes-by-holder"), ["holder"], 8)


@report("i04_balance_daily_bucketed", DAILY)
def _(t):
    return L.balance_daily(bucketed_changes(t), EVENTS_AS_OF)


@report("i09_multi_product_bucketed", sql("daily_bal", """
    select day, products, count(*) as holders
    from (select day, holder, count(distinct token) as products from daily_bal where balance > 0 group by all) group by all"""))
def _(t):
    return L.multi_product_holders(bucketed_changes(t), EVENTS_START, EVENTS_AS_OF)


@report("i05_balance_daily_dense", DAILY)
def _(t):
    return L.balance_daily_dense(changes(t), EVENTS_AS_OF)


@report("i06_balance_from_snapshots", sql("ev event_days", """,
    c as (select pool as token, address as holder, day, arg_max(value, event_id) as balance from ev group by all)
    select c.token, c.holder, d.day, cast(c.balance as double) as balance
    from (select *, lead(day, 1, date '2024-02-01') over (partition by token, holder order by day) as nxt from c) c
    join event_days d on d.day >= c.day and d.day < c.nxt"""))
def _(t):
    snap = t.ev.select(F.col("pool").alias("token"), F.col("address").alias("holder"), "day", "event_id", F.col("value").alias("balance"))
    return L.balance_from_snapshots(snap, ["event_id"], EVENTS_AS_OF)


@report("i07_balance_latest", sql("latest_bal", "select token, holder, cast(balance as double) as balance, last_day from latest_bal"))
def _(t):
    return L.balance_latest(changes(t))


@report("i08_holder_count", sql("daily_bal event_days", """,
    tk as (select distinct token from daily_bal where balance > 0)
    select tk.token, d.day, count(distinct b.holder) as holders
    from tk cross join event_days d left join daily_bal b on b.token = tk.token and b.day = d.day and b.balance > 0
    group by all"""))
def _(t):
    return L.holder_count(changes(t), EVENTS_START, EVENTS_AS_OF)


@report("i08_holder_count_total", sql("daily_bal event_days", """
    select d.day, count(b.holder) as holders from event_days d left join daily_bal b on b.day = d.day and b.balance > 0 group by all"""))
def _(t):
    return L.holder_count(changes(t), EVENTS_START, EVENTS_AS_OF, by=())


@report("i09_multi_product_holders", sql("daily_bal", """
    select day, products, count(*) as holders
    from (select day, holder, count(distinct token) as products from daily_bal where balance > 0 group by all) group by all"""))
def _(t):
    return L.multi_product_holders(changes(t), EVENTS_START, EVENTS_AS_OF)


def holder_sets(t: Tables):
    """Stored sets of holders per (token, day); the reports below read nothing else."""
    numbers, sets = scratch_path(t.spark, "holder-numbers"), scratch_path(t.spark, "holder-sets")
    change = changes(t)
    M.number_members(change, "holder").write.parquet(numbers)
    open_ = L.balance_intervals(change, EVENTS_AS_OF).where("balance > 0")
    M.interval_bitmaps(open_, ["token"], "holder", "day", "next_day", t.spark.read.parquet(numbers)).write.parquet(sets)
    return t.spark.read.parquet(sets)


@report("i08_holder_count_stored", sql("daily_bal", "select token, day, count(distinct holder) as holders from daily_bal where balance > 0 group by all"))
def _(t):
    return M.count_members(holder_sets(t), ["token", "day"])


def _holders_per(unit: str) -> str:
    return sql("daily_bal", f"select token, cast(date_trunc('{unit}', day) as date) as {unit}, count(distinct holder) as holders from daily_bal where balance > 0 group by all")


@report("i08_holders_weekly", _holders_per("week"))
def _(t):
    return M.count_members(holder_sets(t), ["token", F.to_date(F.date_trunc("week", "day")).alias("week")])


@report("i08_holders_monthly", _holders_per("month"))
def _(t):
    return M.count_members(holder_sets(t), ["token", F.to_date(F.date_trunc("month", "day")).alias("month")])


@report("i08_holders_of_any_product", sql("daily_bal", """
    select cast(date_trunc('week', day) as date) as week, count(distinct holder) as holders from daily_bal where balance > 0 and token in ('P1', 'P2', 'P3') group by all"""))
def _(t):
    chosen = holder_sets(t).where(F.col("token").isin("P1", "P2", "P3"))
    return M.count_members(chosen, [F.to_date(F.date_trunc("week", "day")).alias("week")])


@report("i09_multi_product_stored", sql("daily_bal", """
    select day, products, count(*) as holders
    from (select day, holder, count(distinct token) as products from daily_bal where balance > 0 group by all) group by all"""))
def _(t):
    return M.count_by_overlap(holder_sets(t), ["day"], "token", TOKENS, "products")


@report("i10_exclude_contracts", sql("changes tags", """
    select token, holder, day, cast(change as double) as change from changes
    where holder not in (select address from tags where type = 'contract') and holder not in ('0x00000003', '0x00000007')"""))
def _(t):
    pools = t.spark.createDataFrame([("0x00000003",), ("0x00000007",)], "address string")
    return L.exclude_contracts(changes(t), t.labels, pools)


@report("i11_flag_bots", sql("signed", """
    select distinct token, holder from (
      select token, holder, day, sum(amount) as net, count(*) as n from signed where holder <> '0x00000000' group by all)
    where net <= 1e-14 and n >= 2"""))
def _(t):
    return L.flag_bots(L.signed_ledger(t.transfers).where(F.col("holder") != L.ZERO))


@report("i12_holder_stats", sql("latest_bal", """
    select token, count(*) as ever_held, count(*) filter (where balance >= 1) as holders_now,
           cast(sum(balance) filter (where balance >= 1) as double) / count(*) filter (where balance >= 1) as avg_balance,
           cast(sum(balance) filter (where balance >= 1) as double) as total_balance,
           percentile_cont(0.5) within group (order by cast(balance as double)) filter (where balance >= 1) as median_balance
    from latest_bal group by token"""))
def _(t):
    return L.holder_stats(changes(t))


@report("i13_threshold_change", sql("change_bal", """,
    x as (select token, holder, min(day) filter (where balance >= 25) as start_date,
                 arg_min(balance, day) filter (where balance >= 25) as start_balance,
                 max(day) as end_date, arg_max(balance, day) as end_balance
          from change_bal group by all having min(day) filter (where balance >= 25) is not null)
    select token, holder, start_date, cast(start_balance as double) as start_balance, end_date,
           cast(end_balance as double) as end_balance, count(*) over () as ever_reached,
           count(*) filter (where end_balance >= 25) over () as still_there,
           count(*) filter (where end_balance > start_balance) over () as adding
    from x"""))
def _(t):
    return L.threshold_change(L.balance_on_change(changes(t)), 25)


def matrix(t: Tables):
    return L.cross_holdings(changes(t), "P0", 25, TOKENS, t.labels)


@report("i14_cross_holdings", sql("matrix", "select * from matrix"))
def _(t):
    return matrix(t)


@report("i15_holding_stats", sql("matrix_long", """,
    r as (select token, holder, amount from matrix_long where amount > 0 and token not in ('P0', 'P3', 'P4')
          union all select 'Stable', holder, sum(amount) from matrix_long where amount > 0 and token in ('P3', 'P4') group by holder)
    select token, count(*) as holder_number, cast(sum(amount) as bigint) as total_balance,
           cast(round(cast(sum(amount) as double) / count(*)) as bigint) as avg_balance,
           cast(max(amount) as bigint) as max_balance, cast(min(amount) as bigint) as min_balance,
           cast(round(percentile_cont(0.5) within group (order by cast(amount as double))) as bigint) as median_balance,
           (select count(distinct holder) from matrix_long) as threshold_holders
    from r group by token"""))
def _(t):
    return L.holding_stats(L.holdings_long(matrix(t), TOKENS), ["P3", "P4"], "Stable", skip=["P0"])


@report("i16_portfolio_value", sql("matrix_long event_prices", """,
    px as (select symbol, arg_max(price, day) as price from event_prices group by symbol)
    select holder, cast(round(sum(cast(amount as double) * cast(price as double))) as bigint) as total_value_usd
    from matrix_long left join px on symbol = token group by holder"""))
def _(t):
    px = t.event_prices.groupBy(F.col("symbol").alias("token")).agg(F.max_by("price", "day").alias("price"))
    return L.portfolio_value(L.holdings_long(matrix(t), TOKENS), px)


@report("i17_circulating_supply", sql("transfers changes event_days", """,
    m as (select token, day, sum(case when from_addr = '0x00000000' then value else -value end) as d
          from transfers where from_addr = '0x00000000' or to_addr = '0x00000000' group by all),
    x as (select token, day, sum(change) as c from changes where holder in ('0x00000002', '0x00000005', '0x0000000a', '0x00000010') group by all),
    g as (select token, event_days.day, m.d, x.c from (select distinct token from m) cross join event_days
          left join m using (token, day) left join x using (token, day))
    select token, day, cast(sum(d) over w as double) as total_supply,
           cast(sum(d) over w - coalesce(sum(c) over w, 0) as double) as circulating_supply
    from g window w as (partition by token order by day)"""))
def _(t):
    wallets = t.spark.createDataFrame([("0x00000002",), ("0x00000005",), ("0x0000000a",), ("0x00000010",)], "address string")
    return L.circulating_supply(t.transfers, F.broadcast(wallets), EVENTS_START, EVENTS_AS_OF)
