"""The list of reports, and the shared SQL views of their cross-checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import plain_numbers
from ..sources.canonical import Tables
from ..sources.seeds import FEES, PRODUCTS


@dataclass(frozen=True)
class Report:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return plain_numbers(self.build(Tables(spark, path)))


REPORTS: dict[str, Report] = {}


def report(name: str, sql: str | None = None):
    """Register a builder under ``name``; ``sql`` states the same result."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REPORTS:
            raise ValueError(f"duplicate report {name}")
        REPORTS[name] = Report(name, fn, sql)
        return fn

    return wrap


def rnd(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round sums of doubles, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def _addr(x: str) -> str:
    text = f"cast({x} + 1 as varchar)"
    return f"'0x' || lpad({text}, cast(greatest(8, length({text})) as integer), '0')"


def _values(rows: list[tuple], names: str, dates: tuple[str, ...] = ()) -> str:
    cols = names.split()
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    pick = ", ".join(
        f"cast({c} as date) as {c}" if c in dates else (f"cast({c} as double) as {c}" if isinstance(rows[0][i], float) else c)
        for i, c in enumerate(cols)
    )
    return f"select {pick} from (values {body}) v({', '.join(cols)})"


def _ratio4(num: str, den: str) -> str:
    # whole numbers are divided as bigint, exact and rounded down
    return (f"cast((cast({num} * 1000000 as bigint) // cast({den} * 100 as bigint)) as decimal(18,0))"
            f" * cast(0.0001 as decimal(5,4))")


# name -> (views it needs, text)
VIEWS: dict[str, tuple[str, str]] = {
    "ev": ("", f"""
        select event_id, ts, cast(ts as date) as day, event_id // 4 as block, cast(event_id % 4 as integer) as idx,
               't' || cast(event_id // 8 as varchar) as tx_hash, user_id, {_addr('user_id')} as address,
               'P' || cast(user_id % 5 as varchar) as pool, event_type, cast(value as decimal(18,2)) as value,
               cast(json_extract_string(props, '$.k') as integer) as k
        from events"""),
    "transfers": ("ev", f"""
        select event_id, ts, day, block, idx, tx_hash, 'P' || cast(event_id % 5 as varchar) as token,
               case when event_type = 'signup' then '0x00000000' else address end as from_addr,
               case when event_type = 'error' then '0x00000000' when event_type = 'signup' then address
                    else {_addr('((event_id * 7) % (user_id + 1))')} end as to_addr,
               value
        from ev"""),
    "event_prices": ("ev", f"""
        select pool as symbol, day, cast({_ratio4('sum(value)', 'count(*)')} as decimal(18,4)) as price from ev group by all"""),
    "ord": ("", f"""
        select o_orderkey, o_custkey, o_orderstatus, cast(cast(o_totalprice as decimal(18,2)) * cast(0.001 as decimal(4,3)) as decimal(18,5)) as amount,
               o_orderdate as ts, cast(o_orderdate as date) as day,
               'P' || cast(cast(substr(o_orderpriority, 1, 1) as integer) - 1 as varchar) as symbol,
               'o' || cast(o_orderkey as varchar) as tx_hash, {_addr('o_custkey')} as wallet
        from orders"""),
    "issued": ("ord", "select ts, day, tx_hash, symbol, wallet, amount from ord where o_orderstatus <> 'O'"),
    "redeemed": ("ord", "select ts, day, tx_hash, symbol, wallet, amount from ord where o_orderstatus = 'O'"),
    "exchange_txs": ("", "select 'o' || cast(l_orderkey as varchar) as tx_hash from lineitem where l_returnflag = 'R'"),
    "order_ledger": ("ord", f"""
        select ts, day, o_orderkey as block, 0 as idx, tx_hash, symbol as token,
               case when o_orderstatus = 'F' then '0x00000000' else wallet end as from_addr,
               case when o_orderstatus = 'O' then '0x00000000' when o_orderstatus = 'F' then wallet
                    else {_addr('((o_orderkey * 3) % (o_custkey + 1))')} end as to_addr,
               amount as value
        from ord"""),
    "lines": ("", """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(18,2)) as qty,
               cast(l_extendedprice as decimal(18,2)) as paid, cast(l_shipdate as date) as day,
               'P' || cast(cast(substr(p_brand, 7, 4) as integer) % 5 as varchar) as symbol, p_brand as brand, p_type as kind
        from lineitem join part on l_partkey = p_partkey"""),
    "prices": ("lines", f"""
        select symbol, day, cast({_ratio4('sum(paid)', 'sum(qty)')} as decimal(18,4)) as price from lines group by all"""),
    "trades": ("lines", """
        select 'o' || cast(l_orderkey as varchar) as tx_hash,
               cast(l_partkey as varchar) || '-' || cast(l_suppkey as varchar) || '-' || cast(qty as varchar) || '-' || cast(paid as varchar) as trace,
               l_linenumber as evt_index, day, cast(day as timestamp) as minute,
               case when l_suppkey % 2 = 0 then symbol else 'B' || cast(l_linenumber % 3 as varchar) end as token_a,
               case when l_suppkey % 2 = 0 then qty else paid end as amount_a,
               case when l_suppkey % 2 = 0 then 'B' || cast(l_linenumber % 3 as varchar) else symbol end as token_b,
               case when l_suppkey % 2 = 0 then paid else qty end as amount_b
        from lines"""),
    "base_prices": ("ord", f"""
        select cast(day as timestamp) as minute, symbol, price from (
          select day, unnest(['B0', 'B1', 'B2']) as symbol,
                 unnest([cast({_ratio4('sum(amount)', 'count(*)')} as decimal(18,4)), cast({_ratio4('max(amount)', '100')} as decimal(18,4)), cast(1 as decimal(18,4))]) as price
          from ord group by day)"""),
    "holders": ("", f"""
        select {_addr('c_custkey')} as address, cast(c_acctbal as decimal(18,2)) as balance from customer where c_acctbal > 0"""),
    "tags": ("", f"""
        select {_addr('c_custkey')} as address, case when c_nationkey < 3 then 'contract' else 'owner' end as type,
               c_mktsegment as name from customer"""),
    "products": ("", _values(PRODUCTS, "symbol name kind inception venue base", ("inception",))),
    "fees": ("", _values(FEES, "symbol partner begin_date end_date streaming_fee issue_fee redeem_fee partner_split", ("begin_date", "end_date"))),
    "ev_issuance": ("ev", """
        select ts, day, tx_hash, pool as symbol, address as wallet, value as amount,
               case when event_type = 'error' then 'Redeem' else 'Issue' end as evt_type
        from ev where event_type in ('purchase', 'signup', 'error')"""),
    "swaps": ("ev", """
        select event_id, ts, day, block, idx, tx_hash, pool, address, event_type, date_trunc('hour', ts) as hour, value as amount0, k as amount1
        from ev where event_type in ('view', 'click')"""),
    "base_minutes": ("ev", """
        select case when event_type = 'signup' then 'B0' else 'B1' end as symbol, date_trunc('minute', ts) as minute, value as price
        from ev where event_type in ('signup', 'purchase')"""),
    "event_hours": ("", """
        select h as hour from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 hour) g(h)"""),
    "event_days": ("", """
        select cast(d as date) as day from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day) g(d)"""),
    "order_days": ("", """
        select cast(d as date) as day from generate_series(timestamp '1995-01-01', timestamp '2001-08-01', interval 1 day) g(d)"""),
}


def define_view(name: str, needs: str, text: str) -> None:
    VIEWS[name] = (needs, text)


def sql(views: str, body: str) -> str:
    """Prefix a query with the shared views it names and what those need.

    A body that starts with a comma goes on with views of its own.
    """
    order: list[str] = []

    def visit(v: str) -> None:
        for dep in VIEWS[v][0].split():
            visit(dep)
        if v not in order:
            order.append(v)

    for v in views.split():
        visit(v)
    body = body.strip()
    head = ",\n".join(f"{v} as ({VIEWS[v][1]})" for v in order)
    if body.startswith(","):
        return f"with {head}{body}" if head else f"with {body[1:]}"
    return f"with {head}\n{body}" if head else body
