"""Market capture, market share and statistics reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import stats as S
from ..sources.canonical import Tables
from ..sources.seeds import products
from .registry import define_view, report, rnd, sql

MEMBERS = [("P1", "1995-02-01", "1995-02-01"), ("P2", "1995-06-01", "1999-12-31"), ("P3", "1996-01-01", "1996-01-01"), ("P4", "1997-05-05", "2000-05-05")]
SYMBOLS = ["P0", "P1", "P2", "P3", "P4"]


@report("p01_market_capture", sql("ord lines", """,
    m(symbol, i, o) as (values ('P1', date '1995-02-01', date '9999-12-31'), ('P2', date '1995-06-01', date '1999-12-31'), ('P3', date '1996-01-01', date '9999-12-31'), ('P4', date '1997-05-05', date '2000-05-05')),
    c as (select day, cast(sum(cap) as double) as members_cap from (
            select symbol, day, arg_min(amount, o_orderkey) as cap from ord join m using (symbol) where day between i and o group by all) group by day),
    x as (select day, cast(arg_min(paid, (l_orderkey, l_linenumber, l_partkey, paid)) as double) as index_cap from lines group by day)
    select x.day, index_cap, members_cap, round(index_cap / nullif(members_cap, 0) * 100, 3) as market_capture from x left join c on c.day = x.day"""))
def _(t):
    rows = t.spark.createDataFrame(MEMBERS, "symbol string, i string, o string")
    members = F.broadcast(rows.select("symbol", F.col("i").cast("date").alias("in_day"), F.col("o").cast("date").alias("out_day")))
    caps = t.orders.select("symbol", "day", F.col("amount").alias("cap"), "o_orderkey")
    idx = t.lines.select("day", F.col("paid").alias("cap"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "paid").alias("o_orderkey"))
    return M.market_capture(idx, caps, members, ["o_orderkey"])


define_view("mshare", "ord products order_days", """
    with d as (select symbol, day, cast(sum(amount) as double) / count(*) as cap from ord where o_orderstatus = 'F' group by all),
    f as (select s.symbol, e.day, last_value(d.cap ignore nulls) over (partition by s.symbol order by e.day rows unbounded preceding) as cap
          from (select symbol, min(day) as a from d group by symbol) s join order_days e on e.day >= s.a and e.day <= (select max(day) from d)
          left join d on d.symbol = s.symbol and d.day = e.day),
    p as (select kind as project, day, sum(cap) as cap from f join products using (symbol) group by all)
    select project, day, cap, cap / sum(cap) over (partition by day) * 100 as percent from p""")


def mshare(t: Tables):
    caps = t.orders.where("o_orderstatus = 'F'").select("symbol", "day", F.col("amount").alias("cap"))
    return M.market_share(caps, products(t.spark).select("symbol", F.col("kind").alias("project")))


@report("p02_market_share", sql("mshare", "select project, day, round(cap, 9) as cap, round(percent, 9) as percent from mshare"))
def _(t):
    return rnd(mshare(t), 9, "cap", "percent")


@report("p02_market_share_wide", sql("mshare", """
    select day, round(coalesce(max(percent) filter (where project = 'simple'), 0), 9) as simple,
           round(coalesce(max(percent) filter (where project = 'leveraged'), 0), 9) as leveraged from mshare group by day"""))
def _(t):
    return rnd(M.market_share_wide(mshare(t), ["simple", "leveraged"]), 9, "simple", "leveraged")


define_view("sratio", "ord prices", """
    with x as (select symbol, day, cast(sum(amount) as double) as market_cap from ord group by all), s as (select symbol, count(*) / 20000.0::double as total_supply from ord group by symbol)
    select x.symbol, x.day, market_cap, cast(price as double) * total_supply as fully_diluted,
           case when market_cap / nullif(cast(price as double) * total_supply, 0) > 1 then 0 else market_cap / nullif(cast(price as double) * total_supply, 0) end as percent_supply
    from x join prices p on p.symbol = x.symbol and p.day = x.day join s on s.symbol = x.symbol""")


def sratio(t: Tables):
    caps = t.orders.groupBy("symbol", "day").agg(F.sum("amount").cast("double").alias("market_cap"))
    supply = t.orders.groupBy("symbol").agg((F.count(F.lit(1)) / F.lit(20000.0)).alias("total_supply"))
    return M.supply_ratio(t.prices.join(caps, ["symbol", "day"]), supply)


@report("p03_supply_ratio", sql("sratio", "select * from sratio"))
def _(t):
    return sratio(t)


@report("p03_supply_ratio_wide", sql("sratio", "select day, " + ", ".join(
    f"last_value(max(percent_supply) filter (where symbol = '{s}') ignore nulls) over (order by day rows unbounded preceding) as {s}" for s in SYMBOLS) + " from sratio group by day"))
def _(t):
    return M.wide_filled(sratio(t), SYMBOLS, "percent_supply")


@report("p04_screen", sql("", """
    , u as (select p_partkey as id, p_name as name, p_retailprice as market_cap from part where p_type = 'PROMO'
            union select p_partkey, p_name, p_retailprice from part where p_brand in ('Brand#1', 'Brand#2') union select p_partkey, p_name, p_retailprice from part where p_size > 40)
    select * from u"""))
def _(t):
    part = t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("market_cap"), "p_type", "p_brand", "p_size")
    lists = [part.where("p_type = 'PROMO'"), part.where("p_brand in ('Brand#1', 'Brand#2')"), part.where("p_size > 40")]
    return M.screen([df.select("id", "name", "market_cap") for df in lists])


define_view("pair", "prices", """
    select a.day, cast(a.price as double) as price, cast(b.price as double) as base_price from prices a join prices b on b.day = a.day and b.symbol = 'P1' where a.symbol = 'P0'""")


def pair(t: Tables):
    return S.ratio_series(t.prices.where("symbol = 'P0'"), t.prices.where("symbol = 'P1'"), "day")


def _spearman_sql(src: str) -> str:
    return f"""
    r as (select rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0 as x,
                 rank() over (order by base_price) + (count(*) over (partition by base_price) - 1) / 2.0 as y from {src})
    select count(*) as n, round(corr(cast(x as double), cast(y as double)), 9) as rho from r"""


@report("p05_spearman", sql("pair", "," + _spearman_sql("pair")))
def _(t):
    return rnd(S.spearman(pair(t), "price", "base_price"), 9, "rho")


@report("p05_spearman_last_90", sql("pair", ", l as (select * from pair order by day desc limit 90)," + _spearman_sql("l")))
def _(t):
    return rnd(S.spearman(S.last_rows(pair(t), "day", 90), "price", "base_price"), 9, "rho")


@report("p05_spearman_rows", sql("lines", "," + _spearman_sql("(select cast(qty as double) as price, cast(paid as double) as base_price from lines)")))
def _(t):
    return rnd(S.spearman(t.lines, "qty", "paid"), 9, "rho")


@report("p06_linreg", sql("pair", """,
    s as (select count(*) as n, regr_slope(price, base_price) as slope, regr_intercept(price, base_price) as intercept, corr(price, base_price) as r,
                 regr_sxx(price, base_price) as xx, regr_syy(price, base_price) as yy from pair)
    select n, round(slope, 9) as slope, round(intercept, 5) as intercept, round(r, 9) as r, round(sqrt((1 - r * r) * yy / xx / (n - 2)), 9) as std_err from s"""))
def _(t):
    return rnd(rnd(S.linreg(pair(t), "base_price", "price").drop("p_value", "log10_p"), 9, "slope", "r", "std_err"), 5, "intercept")


def _tail_sql(a: str) -> str:
    """Integral of (cos x / cos a)**(dof - 1) from a as far as it matters, by Simpson's rule."""
    n = S.TAIL_STEPS
    reach = f"least({math.pi / 2} - {a}, 40.0::double / ((dof - 1) * tan({a}) + sqrt(dof)))"
    weight = f"case when i = 0 or i = {n} then 1.0 when i % 2 = 1 then 4.0 else 2.0 end"
    at = f"{a} + i * {reach} / {n}.0::double"
    return f"(list_sum(list_transform(range({n + 1}), lambda i: {weight}::double * exp((dof - 1) * (ln(greatest(cos({at}), 1e-300)) - ln(cos({a})))))) * {reach} / {3 * n}.0::double)"


@report("p06_linreg_p_value", sql("pair", f""",
    s as (select count(*) as n, regr_slope(price, base_price) as slope, corr(price, base_price) as r, regr_sxx(price, base_price) as xx, regr_syy(price, base_price) as yy from pair),
    u as (select n, cast(n - 2 as double) as dof, slope / sqrt((1 - r * r) * yy / xx / (n - 2)) as t from s),
    v as (select n, dof, atan(abs(t) / sqrt(dof)) as a, 0.0::double as o from u),
    l as (select n, (dof - 1) * ln(cos(a)) + ln({_tail_sql("a")}) - ln({_tail_sql("o")}) as lp from v)
    select n, round(exp(lp), 9) as p_value, round(lp / {math.log(10)}, 6) as log10_p from l"""))
def _(t):
    return rnd(rnd(S.linreg(pair(t), "base_price", "price").select("n", "p_value", "log10_p"), 9, "p_value"), 6, "log10_p")


@report("p07_bootstrap_ci", sql("prices", f""",
    d as (select datediff('day', date '1970-01-01', day) as k, cast(price as double) - avg(cast(price as double)) over () as x from prices where symbol = 'P0'),
    a as (select *, (k & {S.MASK})::bigint as h0 from d),
    b as (select x, (xor(h0, h0 >> 15) * {0x2C1B3C6D}) & {S.MASK} as h1 from a),
    c as (select x, (xor(h1, h1 >> 12) * {0x297A2D39}) & {S.MASK} as h2 from b),
    e as (select x, rep, xor(xor(h2, h2 >> 15), (rep * 2654435761) & {S.MASK}) as g0 from c, (select unnest(range(1, 10001)) as rep)),
    f as (select x, rep, (xor(g0, g0 >> 15) * {0x2C1B3C6D}) & {S.MASK} as g1 from e),
    g as (select x, rep, (xor(g1, g1 >> 12) * {0x297A2D39}) & {S.MASK} as g2 from f),
    u as (select x, rep, xor(g2, g2 >> 15) as u from g),
    w as (select x, rep, {" + ".join(f"(u >= {edge})::int" for edge in S.POISSON)} as w from u),
    s as (select rep, sum(w)::double as w, sum(w * x) as wx, sum(w * x * x) as wxx from w group by rep),
    v as (select sqrt(greatest((wxx - wx * wx / w) / (w - 1), 0)) as s from s)
    select (select count(*) from d) as n, (select round(stddev_samp(x), 6) from d) as std, round(quantile_cont(s, 0.025), 6) as ci_low, round(quantile_cont(s, 0.975), 6) as ci_high from v"""))
def _(t):
    return rnd(S.bootstrap_ci(t.prices.where("symbol = 'P0'"), "day", "price", n_boot=10000, seed=0), 6, "std", "ci_low", "ci_high")


@report("p08_rolling", sql("ord", """,
    d as (select day, sum(amount) as volume from ord group by day)
    select day, cast(volume as double) as volume, """ + ", ".join(
    f"case when count(*) over w{n} = {n} then cast(sum(volume) over w{n} as double) end as sum_{n}, case when count(*) over w{n} = {n} then cast(sum(volume) over w{n} as double) / {n} end as mean_{n}"
    for n in (7, 30)) + """
    from d window w7 as (order by day rows 6 preceding), w30 as (order by day rows 29 preceding)"""))
def _(t):
    return S.rolling(t.orders.groupBy("day").agg(F.sum("amount").alias("volume")), [], "day", "volume")


@report("p09_overlay", sql("pair", """
    select day, 'price' as series, 100.0::double * price / max(price) over () as percent_of_peak from pair
    union all select day, 'base_price', 100.0::double * base_price / max(base_price) over () from pair"""))
def _(t):
    return S.overlay(pair(t), "day", ["price", "base_price"])


@report("p09_ratio_series", sql("pair", "select *, price / nullif(base_price, 0) as ratio from pair"))
def _(t):
    return pair(t)
