"""Scans, expressions, joins, aggregates, windows, set operations, densification."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as B
from ..functions import uint256 as U
from ..functions import windows as W
from ..functions.frames import stack
from ..functions.tables import create_lp_positions
from ..operators import aggregates as A
from ..operators import bitmaps as M
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import timeseries as T
from ..operators.governance import DECIDING
from ..operators.liquidity import lp_share
from ..operators.market import wide_filled
from ..operators.ordering import exact_quantile, exact_quantiles, group_median, ordered_scan
from ..operators.staking import top_stakes
from ..operators.stats import rolling
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.canonical import EVENTS_AS_OF, EVENTS_START, ORDERS_AS_OF, ORDERS_START, Tables
from ..sources.seeds import PRODUCTS, fees, products, seed
from ..streaming import daily as D
from .governance import cleaned, winning
from .liquidity import lp_events
from .registry import report, rnd, sql

# -- scans, sources, sinks ---------------------------------------------------


@report("a01_read_events", sql("", """
    select event_id, ts, user_id, value from events where event_type in ('view', 'click') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25'"""))
def _(t):
    return R.read_events(t.spark, f"{t.path}/events.parquet", ["event_id", "ts", "user_id", "value"], "ts", "2024-01-05", "2024-01-25", event_type=["view", "click"])


@report("a02_read_calls", sql("ord", "select tx_hash, symbol, cast(amount as double) as amount from ord where o_orderstatus = 'F'"))
def _(t):
    calls = t.orders.withColumn("call_success", F.col("o_orderstatus") == "F")
    return R.successful_calls(calls).select("tx_hash", "symbol", "amount")


@report("a03_decode_logs", sql("ord", """
    select tx_hash, cast(o_orderkey * 1000000007 as double) as amount, cast(o_custkey as double) as other, '0x' || lpad(lower(to_hex(o_custkey)), 40, '0') as payer
    from ord where o_orderstatus = 'P'"""))
def _(t):
    def word(c):
        return F.lpad(F.hex(c), 64, "0")

    logs = t.orders.select(
        "tx_hash", F.col("o_orderstatus").alias("topic1"), F.concat(F.lit("0x"), word(F.col("o_custkey"))).alias("topic2"),
        F.concat(F.lit("0x"), word(F.col("o_orderkey") * 1000000007), word(F.col("o_custkey"))).alias("data"),
    )
    return R.decode_logs(logs, "P", {"amount": ("data", 0, "number"), "other": ("data", 1, "number"), "payer": ("topic2", 0, "address")})


HIGH = 2**256 - 2**64  # words whose upper 192 bits are set


@report("a03_decode_logs_exact", sql("ord", f"""
    select tx_hash, (cast('{HIGH}' as bignum) + cast(o_orderkey * 1000000007 as bignum))::varchar as amount, cast(-1 - o_custkey as varchar) as change, cast(o_custkey as varchar) as other
    from ord where o_orderstatus = 'P'"""))
def _(t):
    high = F.lit("f" * 48)
    logs = t.orders.select(
        "tx_hash", F.col("o_orderstatus").alias("topic1"),
        F.concat(F.lit("0x"), high, F.lpad(F.hex(F.col("o_orderkey") * 1000000007), 16, "0"), high, F.hex(-1 - F.col("o_custkey")), F.lpad(F.hex("o_custkey"), 64, "0")).alias("data"),
    )
    return R.decode_logs(logs, "P", {"amount": ("data", 0, "uint256_text"), "change": ("data", 1, "int256_text"), "other": ("data", 2, "int256_text")})


@report("a04_read_csv", sql("", "select p_partkey, p_brand, p_retailprice from part"))
def _(t):
    path = scratch_path(t.spark, "parts-csv")
    K.write_csv(t.raw("part").select("p_partkey", "p_brand", "p_retailprice"), path)
    return R.read_csv(t.spark, path, "p_partkey bigint, p_brand string, p_retailprice double")


@report("a05_flatten_votes", sql("ev", """
    select 'v' || cast(event_id as varchar) as vote_id, address as voter, date_trunc('second', ts) as created, 'main' as space, event_type as proposal,
           1 + cast(event_id % 2 as bigint) as choice, cast(value as double) as vp, cast(k as double) as first_strategy from ev"""))
def _(t):
    vote = F.struct(
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("id"), F.col("address").alias("voter"), F.unix_timestamp("ts").alias("created"),
        F.struct(F.lit("main").alias("id")).alias("space"), F.struct(F.col("event_type").alias("id")).alias("proposal"),
        (1 + F.pmod("event_id", F.lit(2))).alias("choice"), B.dbl("value").alias("vp"), F.array(B.dbl("k"), B.dbl("value")).alias("vp_by_strategy"), F.lit("final").alias("vp_state"),
    )
    path = scratch_path(t.spark, "votes-json")
    K.write_json(t.ev.select(F.struct(F.array(vote).alias("votes")).alias("data")), path)
    out = R.flatten_votes(R.read_json(t.spark, path, R.VOTES))
    return out.withColumn("first_strategy", F.element_at("vp_by_strategy", 1)).drop("vp_by_strategy", "vp_state")


@report("a05_flatten_proposals", sql("ord", """
    select tx_hash as proposal_id, ts as created, symbol as title, 2 as n_choices, cast(amount as double) as score_for, cast(o_custkey as bigint) as votes from ord"""))
def _(t):
    p = F.struct(
        F.col("tx_hash").alias("id"), F.unix_timestamp("ts").alias("created"), F.col("symbol").alias("title"), F.lit("text").alias("body"),
        F.array(F.lit("for"), F.lit("against")).alias("choices"), F.array(B.dbl("amount"), F.lit(1.0)).alias("scores"), B.dbl("amount").alias("scores_total"),
        F.col("o_custkey").alias("votes"), F.lit("closed").alias("state"),
    )
    path = scratch_path(t.spark, "proposals-json")
    K.write_json(t.orders.select(F.struct(F.array(p).alias("proposals")).alias("data")), path)
    out = R.flatten_proposals(R.read_json(t.spark, path, R.PROPOSALS))
    return out.select("proposal_id", "created", "title", F.size("choices").alias("n_choices"), F.element_at("scores", 1).alias("score_for"), "votes")


@report("a06_read_addresses", sql("tags", "select address from tags"))
def _(t):
    path = scratch_path(t.spark, "addresses")
    digits = F.upper(F.regexp_replace("address", "^0x", ""))
    t.labels.select(F.concat(F.lit('"0x'), digits, F.lit('"')).alias("value")).write.text(path)
    return R.read_addresses(t.spark, path)


@report("a07_seed_join", sql("ord products", "select symbol, name, count(*) as n from ord join products using (symbol) group by all"))
def _(t):
    dim = seed(t.spark, [(p[0], p[1]) for p in PRODUCTS], "symbol string, name string")
    return t.orders.join(F.broadcast(dim), "symbol").groupBy("symbol", "name").agg(F.count(F.lit(1)).alias("n"))


@report("a08_write_seed", sql("ord fees", "select symbol, partner, streaming_fee, count(*) as n from ord join fees using (symbol) where day between begin_date and end_date group by all"))
def _(t):
    path = scratch_path(t.spark, "fees")
    for _ in range(2):  # a second run replaces the table
        table = K.write_seed(fees(t.spark), path)
    j = J.scd_join(t.orders.select("symbol", "day"), table, ["symbol"], "day", "begin_date", "end_date", "inner")
    return j.groupBy("symbol", "partner", "streaming_fee").agg(F.count(F.lit(1)).alias("n"))


@report("a09_named_views", sql("prices products", "select name, cast(price as double) as price, day from prices join products using (symbol)"))
def _(t):
    K.register_views(t.spark, {"day_prices": t.prices, "product_dim": products(t.spark)})
    return t.spark.sql("select name, price, day from day_prices join product_dim using (symbol)")


@report("a10_materialize", sql("changes", "select token, count(*) as days, cast(sum(change) as double) as total from changes group by token"))
def _(t):
    step = K.materialize(L.daily_change(L.signed_ledger(t.transfers)), scratch_path(t.spark, "changes"))
    return step.groupBy("token").agg(F.count(F.lit(1)).alias("days"), F.sum("change").alias("total"))


@report("a11_cached_union", sql("prices", "select symbol, day, cast(price as double) as price from prices"))
def _(t):
    path = scratch_path(t.spark, "prices")
    K.write_history(t.prices, path, "day", "1999-06-15")
    return K.cached_union(t.prices, path, "day", "1999-06-15")


@report("a12_write_json", sql("prices", "select symbol, day, cast(price as double) as price from prices"))
def _(t):
    path = scratch_path(t.spark, "prices-json")
    K.write_json(t.prices, path)
    return R.read_json(t.spark, path, "symbol string, day date, price double")


@report("a13_parameters", sql("ord", """
    select cast(date_trunc('month', day) as date) as period, symbol, cast(sum(amount) as double) as amount from ord
    where day >= date '1996-01-01' and symbol in ('P0', 'P3') group by all"""))
def _(t):
    K.register_views(t.spark, {"order_rows": t.orders})
    text = """select to_date(date_trunc(:unit, day)) as period, symbol, sum(amount) as amount from order_rows
              where day >= cast(:start as date) and array_contains(split(:symbols, ','), symbol) group by 1, 2"""
    return t.spark.sql(text, args={"unit": "month", "start": "1996-01-01", "symbols": "P0,P3"})


# -- expressions -------------------------------------------------------------


@report("b01_scale", sql("ev", "select event_id, cast(k as double) / power(10.0, 3) as units, cast(k as double) / power(10.0, 18) as default_units from ev"))
def _(t):
    return t.ev.select("event_id", B.scale("k", F.lit(3)).alias("units"), B.scale("k", F.lit(None).cast("int")).alias("default_units"))


@report("b02_norm_address", sql("ev", "select event_id, address as a, address as b from ev"))
def _(t):
    raw = F.concat(F.lit(" \\X"), F.substring("address", 3, 20))
    return t.ev.select("event_id", B.norm_address(raw).alias("a"), B.norm_address(F.upper("address")).alias("b"))


@report("b03_split_list", sql("ord", "select symbol, count(*) as n from ord where symbol in ('P1', 'P4') group by symbol"))
def _(t):
    listed = t.spark.range(1).select(B.split_list(F.lit(" P1,p4 ")).alias("s"))
    return t.orders.join(F.broadcast(listed.select(F.upper("s").alias("symbol"))), "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@report("b04_time_buckets", sql("ev", """
    select date_trunc('second', ts) as s, date_trunc('minute', ts) as m, date_trunc('hour', ts) as h, cast(ts as date) as d,
           cast(date_trunc('week', ts) as date) as w, cast(date_trunc('month', ts) as date) as mo from ev"""))
def _(t):
    day = lambda u: F.to_date(F.date_trunc(u, "ts"))
    return t.ev.select(*[F.date_trunc(u, "ts").alias(a) for u, a in (("second", "s"), ("minute", "m"), ("hour", "h"))], F.col("day").alias("d"), day("week").alias("w"), day("month").alias("mo"))


@report("b05_bucket_seconds", sql("ev", "select time_bucket(interval 4 hours, ts, timestamp '1970-01-01') as bucket, count(*) as n from ev group by all"))
def _(t):
    return t.ev.groupBy(B.bucket("ts", 14400).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@report("b06_month_label", sql("ord", "select strftime(day, '%b %Y') as month, count(*) as n from ord group by all"))
def _(t):
    return t.orders.groupBy(B.month_label("day").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@report("b07_date_arithmetic", sql("ord", """
    select o_orderkey, date_diff('day', date '1995-01-01', day) as days, date_diff('day', date '1995-01-01', day) // 7 as week,
           date_diff('day', date '1995-01-01', day) % 7 as rest, cast(day - interval 7 day as date) as before from ord"""))
def _(t):
    days = F.datediff("day", F.lit("1995-01-01").cast("date"))
    return t.orders.select("o_orderkey", days.alias("days"), F.floor(days / 7).alias("week"), F.pmod(days, F.lit(7)).alias("rest"), F.date_sub("day", 7).alias("before"))


@report("b08_epoch_parts", sql("ev", """
    select event_id, year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h, isodow(ts) - 1 as wd, strftime(ts, '%a') as wn from ev"""))
def _(t):
    back = F.timestamp_millis(F.floor(F.unix_micros("ts") / 1000))
    e = t.ev.select("event_id", back.alias("x"))
    return e.select("event_id", F.year("x").alias("y"), F.month("x").alias("m"), F.dayofmonth("x").alias("d"), F.hour("x").alias("h"), F.weekday("x").alias("wd"), F.date_format("x", "E").alias("wn"))


@report("b09_banding", sql("ord", """
    select case when amount >= 250 then '250+' when amount >= 50 then '50-249' when amount >= 10 then '10-49' else '<10' end as band, count(*) as n from ord group by all"""))
def _(t):
    return t.orders.groupBy(B.band("amount", [(250, "250+"), (50, "50-249"), (10, "10-49")], "<10").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@report("b10_category", sql("", """
    select p_partkey, case when p_name like '%ring%' then 'ring' when p_name like '%bolt%' then 'bolt' else 'other' end as category from part"""))
def _(t):
    return t.raw("part").select("p_partkey", B.category_of("p_name", [("ring", "ring"), ("bolt", "bolt")], "other").alias("category"))


@report("b11_scalar_functions", sql("ev", """
    select event_id, coalesce(nullif(k, 0), -1) as a, greatest(k, 50) as b, least(k, 50) as c, abs(k - 50) as d, sqrt(cast(k as double)) as e,
           power(cast(k as double), 2) as f, round(log10(k + 1.0), 9) as g, round(ln(k + 1.0) / ln(2.0), 9) as h from ev"""))
def _(t):
    k = F.col("k")
    return t.ev.select(
        "event_id", F.coalesce(F.nullif(k, F.lit(0)), F.lit(-1)).alias("a"), F.greatest(k, F.lit(50)).alias("b"), F.least(k, F.lit(50)).alias("c"), F.abs(k - 50).alias("d"),
        F.sqrt(B.dbl(k)).alias("e"), F.pow(B.dbl(k), F.lit(2.0)).alias("f"), F.round(F.log10(k + 1.0), 9).alias("g"), F.round(F.log(k + 1.0) / F.log(F.lit(2.0)), 9).alias("h"),
    )


@report("b12_sort_key", sql("ev", "select lpad(cast(block as varchar), 19, '0') || lpad(cast(idx as varchar), 19, '0') as ky, event_id from ev"))
def _(t):
    return t.ev.select(B.sort_key("block", "idx").alias("ky"), "event_id")


@report("b13_tick_price", sql("ev", """
    select event_id, round(power(1.0001::double, k * 60 - 3000) * 0.01::double, 12) as p,
           round((k + 1.0::double) * 79228162514264337593543950336.0::double * ((k + 1.0::double) * 79228162514264337593543950336.0::double)
                 / 6277101735386680763835789423207666416102355444464034512896.0::double * 100.0::double, 6) as q from ev"""))
def _(t):
    q96 = (F.col("k") + F.lit(1.0)) * F.lit(2.0**96)
    return t.ev.select("event_id", F.round(B.tick_price(F.col("k") * 60 - 3000, 0, 2), 12).alias("p"), F.round(B.sqrt_price(q96, 2, 0), 6).alias("q"))


@report("b14_predicates", sql("ev", """
    select event_id from ev where event_type in ('view', 'click') and value between 10 and 50 and not (k < 20 or k is null)"""))
def _(t):
    keep = F.col("event_type").isin("view", "click") & F.col("value").between(10, 50) & ~((F.col("k") < 20) | F.col("k").isNull())
    return t.ev.where(keep).select("event_id")


@report("b15_text_concat", sql("trades", "select token_a || '-' || token_b as pair, 'cost - ' || token_a as detail, count(*) as n from trades group by all"))
def _(t):
    return t.trades.groupBy(F.concat_ws("-", "token_a", "token_b").alias("pair"), F.concat(F.lit("cost - "), F.col("token_a")).alias("detail")).agg(F.count(F.lit(1)).alias("n"))


@report("b16_array_lookup", sql("ev", "select event_id, cast(case when event_id % 2 = 0 then value else k end as double) as score, 2 as n from ev"))
def _(t):
    scores = F.array(B.dbl("value"), B.dbl("k"))
    a = t.ev.select("event_id", scores.alias("scores"), (1 + F.pmod("event_id", F.lit(2))).cast("int").alias("choice"))
    return a.select("event_id", F.element_at("scores", F.col("choice")).alias("score"), F.size("scores").alias("n"))


@report("b17_percent_of_peak", sql("prices", """
    select symbol, day, 100.0::double * cast(price as double) / cast(max(price) over () as double) as pct from prices"""))
def _(t):
    peak = t.prices.agg(F.max(B.dbl("price")).alias("_p"))
    return J.scalar_join(t.prices, peak).select("symbol", "day", (F.lit(100.0) * B.dbl("price") / F.col("_p")).alias("pct"))


# -- joins -------------------------------------------------------------------


@report("c01_inner_join", sql("trades prices", "select t.tx_hash, t.evt_index, t.trace, cast(p.price as double) as price from trades t join prices p on p.symbol = t.token_a and p.day = t.day"))
def _(t):
    p = t.prices.withColumnRenamed("symbol", "token_a")
    return t.trades.join(p, ["token_a", "day"]).select("tx_hash", "evt_index", "trace", "price")


@report("c02_left_join_spine", sql("ord order_days", "select d.day, coalesce(cast(sum(amount) as double), 0) as amount from order_days d left join ord using (day) group by d.day"))
def _(t):
    per = t.orders.groupBy("day").agg(F.sum("amount").alias("amount"))
    return T.spine(t.spark, ORDERS_START, ORDERS_AS_OF).join(per, "day", "left").select("day", F.coalesce(B.dbl("amount"), F.lit(0.0)).alias("amount"))


@report("c03_right_join", sql("swaps event_hours", """
    select hour, round(r, 9) as r from (select hour, avg(cast(amount1 as double) / cast(amount0 as double)) as r from swaps where pool = 'P0' group by hour) right join event_hours using (hour)"""))
def _(t):
    px = t.swaps.where("pool = 'P0'").groupBy("hour").agg(F.avg(B.safe_div("amount1", "amount0")).alias("r"))
    return rnd(px.join(T.spine(t.spark, EVENTS_START, EVENTS_AS_OF, "1 hour", "hour"), "hour", "right"), 9, "r")


@report("c04_full_join_three_way", sql("ev", """,
    m as (select pool, date_trunc('hour', ts) as hour, sum(value) as m from ev where event_type = 'purchase' group by all),
    b as (select pool, date_trunc('hour', ts) as hour, sum(value) as b from ev where event_type = 'error' group by all),
    s as (select pool, date_trunc('hour', ts) as hour, sum(value) as s from ev where event_type = 'view' group by all)
    select pool, hour, cast(m as double) as m, cast(b as double) as b, cast(s as double) as s from m full join b using (pool, hour) full join s using (pool, hour)"""))
def _(t):
    def part(kind, name):
        return t.of_type(kind).groupBy("pool", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias(name))

    keys = ["pool", "hour"]
    return part("purchase", "m").join(part("error", "b"), keys, "full").join(part("view", "s"), keys, "full")


@report("c05_cross_join_calendar", sql("products order_days ord", """
    select p.symbol, d.day, count(o.o_orderkey) as n from products p cross join order_days d left join ord o on o.symbol = p.symbol and o.day = d.day group by all"""))
def _(t):
    grid = products(t.spark).select("symbol").crossJoin(F.broadcast(T.spine(t.spark, ORDERS_START, ORDERS_AS_OF)))
    per = t.orders.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(per, ["symbol", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@report("c06_one_row_join", sql("ord trades", "select * from (select count(*) as orders from ord) join (select count(*) as trades from trades) on 1 = 1"))
def _(t):
    return J.scalar_join(t.orders.agg(F.count(F.lit(1)).alias("orders")), t.trades.agg(F.count(F.lit(1)).alias("trades")))


@report("c07_semi_join", sql("transfers tags", "select event_id from transfers where to_addr in (select address from tags where type = 'contract')"))
def _(t):
    return t.transfers.join(t.labels.where("type = 'contract'").select(F.col("address").alias("to_addr")), "to_addr", "left_semi").select("event_id")


@report("c08_anti_join", sql("transfers tags", "select event_id from transfers where to_addr not in (select address from tags where type = 'contract')"))
def _(t):
    return t.transfers.join(t.labels.where("type = 'contract'").select(F.col("address").alias("to_addr")), "to_addr", "left_anti").select("event_id")


@report("c09_expand_intervals", sql("ev event_days", """,
    s as (select address, day, cast(sum(value) as double) as v from ev group by all),
    c as (select *, lead(day, 1, date '2024-02-01') over (partition by address order by day) as nxt from s)
    select address, d.day, v from c join event_days d on c.day <= d.day and d.day < c.nxt"""))
def _(t):
    c = t.ev.groupBy("address", "day").agg(F.sum("value").alias("v"))
    return T.expand_intervals(T.step_intervals(c, ["address"], "day", EVENTS_AS_OF), "day", "next_day", "day")


@report("c09_interval_join", sql("ev event_days", """
    , b as (select *, lead(day, 1, date '2024-02-01') over (partition by address order by day) as next_day from (select address, day, sum(value) as v from ev group by all))
    select b.address, cast(b.v as double) as v, d.day from b join event_days d on b.day <= d.day and d.day < b.next_day"""))
def _(t):
    c = t.ev.groupBy("address", "day").agg(F.sum("value").alias("v"))
    steps = T.step_intervals(c, ["address"], "day", EVENTS_AS_OF)
    days = T.spine(t.spark, EVENTS_START, EVENTS_AS_OF)
    out = J.interval_join(days, steps, [], ("day", "day"), ("day", "next_day"), closed=False)
    return out.select(F.col("_r_address").alias("address"), F.col("_r_v").alias("v"), "day")


@report("c10_scd_join", sql("prices fees", """
    select p.symbol, p.day, partner, streaming_fee from prices p left join fees f on f.symbol = p.symbol and p.day >= f.begin_date and p.day <= f.end_date"""))
def _(t):
    return J.scd_join(t.prices, fees(t.spark), ["symbol"], "day", "begin_date", "end_date").select("symbol", "day", "partner", "streaming_fee")


@report("c11_either_side_join", sql("trades base_prices", """
    select distinct tx_hash, trace, evt_index, b.symbol, cast(case when t.token_a = b.symbol then amount_a else amount_b end as double) as amount,
           cast(price as double) as price, cast(case when t.token_a = b.symbol then amount_a else amount_b end * price as double) as usd_amount
    from trades t join base_prices b on b.minute = t.minute and (t.token_a = b.symbol or t.token_b = b.symbol)"""))
def _(t):
    return J.either_side_join(t.trades, t.base_prices, ["tx_hash", "trace", "evt_index"], "minute", ("token_a", "amount_a"), ("token_b", "amount_b")).drop("minute")


@report("c12_asof_last", sql("ev", """
    select a.event_id, cast(b.value as double) as last_value from (select * from ev where event_type = 'view') a
    asof left join (select * from ev where event_type = 'click') b on a.pool = b.pool and a.event_id >= b.event_id"""))
def _(t):
    right = t.of_type("click").select("pool", "event_id", F.col("value").alias("last_value"))
    left = t.of_type("view").select("pool", "event_id")
    return J.asof_last(left, right, ["pool"], ["event_id"], ["last_value"], F.floor(F.col("event_id") / 500)).drop("pool")


@report("c13_last_in_transaction", sql("ev", """
    select a.event_id, b.event_id as before, cast(b.value as double) as last_value from ev a join ev b on b.tx_hash = a.tx_hash and b.event_id < a.event_id
    where a.event_type = 'view' and b.event_type = 'click' qualify row_number() over (partition by a.event_id order by b.event_id desc) = 1"""))
def _(t):
    right = t.of_type("click").select("tx_hash", "event_id", "value")
    left = t.of_type("view").select("tx_hash", "event_id")
    cols = right.withColumns({"before": F.col("event_id"), "last_value": F.col("value")}).drop("value")
    out = J.asof_last(left, cols, ["tx_hash"], ["event_id"], ["before", "last_value"], F.floor(F.col("event_id") / 1000), inclusive=False)
    return out.where("before is not null").drop("tx_hash")


@report("c14_row_offset_join", sql("ev", """
    select pool, event_id, cast(value - lag(value) over (partition by pool order by event_id) as double) as change from ev"""))
def _(t):
    rows = t.ev.select("pool", "event_id", "value")
    out = J.previous_row(rows, ["pool"], ["event_id"], [("value", "prev")], F.floor(F.col("event_id") / 500))
    return out.select("pool", "event_id", (F.col("value") - F.col("prev")).alias("change"))


@report("c15_member_join", sql("prices", """
    select symbol, day, cast(price as double) as price from prices where (symbol = 'P1' and day >= date '1996-01-01') or (symbol = 'P2' and day between date '1995-06-01' and date '1998-12-31')"""))
def _(t):
    m = seed(t.spark, [("P1", "1996-01-01", "1996-01-01"), ("P2", "1995-06-01", "1998-12-31")], "symbol string, a string, z string")
    m = F.broadcast(m.select("symbol", F.col("a").cast("date").alias("a"), F.col("z").cast("date").alias("z")))
    return J.member_join(t.prices, m, "symbol", "day", "a", "z")


@report("c16_scalar_subquery", sql("ord", "select o_orderkey, cast(amount as double) as amount from ord where amount > (select cast(sum(amount) as double) / count(*) from ord)"))
def _(t):
    mean = t.orders.agg((F.sum("amount").cast("double") / F.count(F.lit(1))).alias("_m"))
    return J.scalar_join(t.orders.select("o_orderkey", B.dbl("amount").alias("amount")), mean).where("amount > _m").drop("_m")


@report("c17_role_playing_join", sql("trades products", """
    select tx_hash, evt_index, trace, a.name as name_a, b.name as name_b from trades t left join products a on a.symbol = t.token_a left join products b on b.symbol = t.token_b"""))
def _(t):
    def role(side):
        return products(t.spark).select(F.col("symbol").alias(f"token_{side}"), F.col("name").alias(f"name_{side}"))

    return t.trades.join(role("a"), "token_a", "left").join(role("b"), "token_b", "left").select("tx_hash", "evt_index", "trace", "name_a", "name_b")


@report("c18_keyed_merge", sql("ev tags", "select e.address, t.name, count(*) as n from ev e left join tags t on t.address = e.address group by all"))
def _(t):
    per = t.ev.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    return per.join(t.labels.select("address", "name"), "address", "left").select("address", "name", "n")


# -- aggregates --------------------------------------------------------------


@report("d01_group_by", sql("ord", """
    select symbol, day, cast(sum(amount) as double) as s, cast(sum(amount) as double) / count(*) as a, cast(min(amount) as double) as lo, cast(max(amount) as double) as hi, count(*) as n
    from ord group by all"""))
def _(t):
    return t.orders.groupBy("symbol", "day").agg(
        F.sum("amount").alias("s"), (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("a"), F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count(F.lit(1)).alias("n")
    )


@report("d02_count_distinct", sql("transfers", "select day, count(distinct to_addr) as receivers from transfers group by day"))
def _(t):
    return t.transfers.groupBy("day").agg(F.countDistinct("to_addr").alias("receivers"))


@report("d02_count_distinct_stored", sql("ev", "select pool, count(distinct address) as users from ev group by pool"))
def _(t):
    numbers = scratch_path(t.spark, "user-numbers")
    M.number_members(t.ev, "address").write.parquet(numbers)
    daily = M.bitmaps(t.ev.select("pool", "day", "address"), ["pool", "day"], "address", t.spark.read.parquet(numbers))
    return M.count_members(daily, ["pool"], "users")


@report("d03_filtered_aggregates", sql("trades", """
    select day, count(*) filter (where token_a = 'P0') as buys, count(*) filter (where token_b = 'P0') as sells, cast(sum(amount_a) filter (where token_a = 'P0') as double) as bought from trades group by day"""))
def _(t):
    a = F.col("token_a") == "P0"
    return t.trades.groupBy("day").agg(A.count_if(a).alias("buys"), A.count_if(F.col("token_b") == "P0").alias("sells"), A.sum_if(a, "amount_a").alias("bought"))


@report("d04_conditional_sum", sql("ev", "select pool, cast(sum(case when event_type = 'view' then value else 0 end) as double) as v, cast(sum(case when event_type = 'click' then value else 0 end) as double) as c from ev group by pool"))
def _(t):
    def only(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(F.lit(0)))

    return t.ev.groupBy("pool").agg(only("view").alias("v"), only("click").alias("c"))


KINDS = ["view", "click", "signup", "purchase", "error"]


@report("d05_pivot_fixed", sql("ev", "select address, " + ", ".join(f"cast(max(value) filter (where event_type = '{k}') as double) as {k}" for k in KINDS) + " from ev group by address"))
def _(t):
    return A.pivot_fixed(t.ev, ["address"], "event_type", KINDS, F.max("value"))


@report("d06_pivot_counts", sql("ev", "select address, " + ", ".join(f"count(*) filter (where event_type = '{k}') as {k}" for k in KINDS) + " from ev group by address"))
def _(t):
    return A.pivot_fixed(t.ev, ["address"], "event_type", KINDS, F.count(F.lit(1)), 0)


@report("d07_unpivot", sql("", "select c_custkey, 'c_acctbal' as name, c_acctbal as value from customer union all select c_custkey, 'c_nationkey', c_nationkey from customer"))
def _(t):
    c = t.raw("customer").select("c_custkey", "c_acctbal", B.dbl("c_nationkey").alias("c_nationkey"))
    return A.unpivot(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@report("d08_median_exact", sql("ev", "select pool, percentile_cont(0.5) within group (order by cast(value as double)) as median from ev group by pool"))
def _(t):
    return exact_quantile(t.ev, ["pool"], "value", 0.5, "median")


@report("d08_median_total", sql("lines", "select percentile_cont(0.5) within group (order by cast(paid as double)) as median from lines"))
def _(t):
    return exact_quantile(t.lines, [], "paid", 0.5, "median")


@report("d08_median_by_day", sql("ev", """
    , h as (select pool, cast(ts as date) as day, date_trunc('hour', ts) as hour, max(value) as v from ev group by all)
    select pool, day, percentile_cont(0.5) within group (order by cast(v as double)) as median from h group by all"""))
def _(t):
    h = t.ev.groupBy("pool", "day", F.date_trunc("hour", "ts").alias("hour")).agg(F.max("value").alias("v"))
    return group_median(h, ["pool", "day"], "v")


@report("d09_deviation_band", sql("ev", """
    select pool, day, round(avg(cast(value as double)), 9) as mean, round(stddev(value), 9) as sd, round(avg(cast(value as double)) - stddev(value), 9) as low, round(avg(cast(value as double)) + stddev(value), 9) as high from ev group by all"""))
def _(t):
    v = B.dbl("value")
    a = t.ev.groupBy("pool", "day").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return rnd(a.withColumns({"low": F.col("mean") - F.col("sd"), "high": F.col("mean") + F.col("sd")}), 9, "mean", "sd", "low", "high")


@report("d10_vwap", sql("lines", "select symbol, cast(sum(paid) as double) / nullif(cast(sum(qty) as double), 0) as vwap from lines group by symbol"))
def _(t):
    return t.lines.groupBy("symbol").agg(A.vwap("paid", "qty").alias("vwap"))


@report("d11_label_list", sql("ev", "select address, string_agg(distinct event_type, '| ' order by event_type) as labels from ev group by address"))
def _(t):
    return A.label_list(t.ev, "address", "event_type")


@report("d12_latest_row", sql("ev", "select pool, day, arg_max(cast(value as double), event_id) as value, arg_max(k, event_id) as k from ev group by all"))
def _(t):
    return A.latest(t.ev, ["pool", "day"], ["value", "k"], ["block", "idx"])


@report("d13_having", sql("ev", "select address, cast(sum(value) as double) as total from ev group by address having sum(value) > 3000"))
def _(t):
    return t.ev.groupBy("address").agg(F.sum("value").alias("total")).where("total > 3000")


@report("d14_distinct", sql("ev", "select distinct address, pool, day from ev"))
def _(t):
    return t.ev.select("address", "pool", "day").distinct()


@report("d15_one_per_key", sql("ev", "select distinct on (address, day) address, day, cast(value as double) as value, event_id from ev order by address, day, value, event_id"))
def _(t):
    return A.one_per_key(t.ev.select("address", "day", "value", "event_id"), ["address", "day"])


@report("d16_first_of_day", sql("ev", "select pool, day, arg_min(cast(value as double), event_id) as value from ev group by all"))
def _(t):
    return A.earliest(t.ev, ["pool", "day"], ["value"], ["event_id"])


@report("d17_describe", sql("holders", """
    select count(*) as n, cast(sum(balance) as double) / count(*) as mean, round(stddev(balance), 6) as std, cast(min(balance) as double) as min, cast(max(balance) as double) as max,
           round(quantile_cont(cast(balance as double), 0.25), 6) as p25, round(quantile_cont(cast(balance as double), 0.5), 6) as p50, round(quantile_cont(cast(balance as double), 0.75), 6) as p75
    from holders"""))
def _(t):
    quartiles = exact_quantiles(t.holders, [], "balance", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return rnd(J.scalar_join(A.describe(t.holders, "balance"), quartiles), 6, "std", "p25", "p50", "p75")


@report("d18_with_total", sql("ord", """
    select symbol, day, cast(sum(amount) as double) as amount from ord group by all union all select 'Total', day, cast(sum(amount) as double) from ord group by day"""))
def _(t):
    per = t.orders.groupBy("symbol", "day").agg(F.sum("amount").alias("amount"))
    return A.with_total(per, "symbol", ["day"], ["amount"])


@report("d19_histogram_of_counts", sql("transfers", """
    select day, n, count(*) as members from (select day, to_addr, count(distinct token) as n from transfers group by all) group by all"""))
def _(t):
    return A.histogram_of_counts(t.transfers, ["day"], "to_addr", "token")


# -- windows -----------------------------------------------------------------

DAILY = "d as (select symbol, day, sum(amount) as v from ord group by all)"


def daily(t: Tables):
    return t.orders.groupBy("symbol", "day").agg(F.sum("amount").alias("v"))


def _window_report(name: str, text: str, column, digits: int | None = None):
    shown = f"round({text}, {digits})" if digits else text
    body = f", {DAILY} select symbol, day, {shown} as x from d window w as (partition by symbol order by day)"

    @report(name, sql("ord", body))
    def _(t):
        out = daily(t).select("symbol", "day", column().alias("x"))
        return rnd(out, digits, "x") if digits else out


_window_report("e01_running_sum", "cast(sum(v) over (partition by symbol order by day rows unbounded preceding) as double)", lambda: W.running_sum("v", ["symbol"], "day"))


@report("e02_running_sum_peers", sql("ord", "select symbol, day, o_orderkey, cast(sum(amount) over (partition by symbol order by day) as double) as x from ord"))
def _(t):
    # peers share one value: add per day first, run over days, join back
    per = daily(t).select("symbol", "day", W.running_sum("v", ["symbol"], "day").alias("x"))
    return t.orders.select("symbol", "day", "o_orderkey").join(per, ["symbol", "day"])


@report("e02_running_total_events", sql("ev", "select pool, event_id, cast(sum(value) over (partition by pool order by event_id) as double) as x from ev"))
def _(t):
    return J.running_total(t.ev.select("pool", "event_id", "value"), ["pool"], ["event_id"], "value", "x", F.floor(F.col("event_id") / 500)).drop("value")


def _ma(p: int, f: int = 0) -> str:
    frame = f"(partition by symbol order by day rows between {p} preceding and {f} following)" if f else f"(partition by symbol order by day rows {p} preceding)"
    return f"cast(sum(v) over {frame} as double) / count(v) over {frame}"


_window_report("e03_moving_avg_8_rows", _ma(7), lambda: W.moving_avg("v", ["symbol"], "day", 7))
for _n in (7, 12, 28, 30):
    _window_report(f"e04_moving_avg_{_n}_rows", _ma(_n - 1), lambda n=_n: W.moving_avg("v", ["symbol"], "day", n - 1))
_window_report("e05_centred_avg", _ma(14, 14), lambda: W.moving_avg("v", ["symbol"], "day", 14, 14))


@report("e06_window_over_aggregate", sql("ord", """
    select day, cast(sum(amount) as double) as v, cast(sum(sum(amount)) over (order by day rows 7 preceding) as double) / count(*) over (order by day rows 7 preceding) as av from ord group by day"""))
def _(t):
    per = t.orders.groupBy("day").agg(F.sum("amount").alias("v"))
    return per.withColumn("av", W.moving_avg("v", [], "day", 7))


_window_report("e07_lag_7", "cast(lag(v, 7) over w as double)", lambda: W.previous("v", ["symbol"], "day", 7))
_window_report("e07_lag_30", "cast(lag(v, 30) over w as double)", lambda: W.previous("v", ["symbol"], "day", 30))
_window_report("e08_lead_default", "lead(day, 1, date '2001-08-02') over w", lambda: W.following("day", ["symbol"], "day", F.lit("2001-08-02").cast("date")))
_window_report("e09_row_number", "row_number() over w", lambda: F.row_number().over(W.over(["symbol"], "day")))


@report("e10_rank_latest", sql("ord", "select symbol, o_orderkey, day from ord qualify rank() over (partition by symbol order by day desc) = 1"))
def _(t):
    # ties kept: the latest day per group is an aggregate, not a sort of all rows
    last = t.orders.groupBy("symbol").agg(F.max("day").alias("day"))
    return t.orders.select("symbol", "o_orderkey", "day").join(last, ["symbol", "day"], "left_semi")


_window_report("e11_first_value", "cast(first_value(v) over w as double)", lambda: F.first("v").over(W.over(["symbol"], "day").rowsBetween(Window.unboundedPreceding, 0)))


@report("e12_ratio_to_total", sql("holders", "select address, count(*) over () as n, cast(balance as double) / cast(sum(balance) over () as double) as share from holders"))
def _(t):
    total = t.holders.agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("_s"))
    return J.scalar_join(t.holders, total).select("address", "n", B.safe_div("balance", "_s").alias("share"))


@report("e13_cumulative_share", sql("holders", """
    select address, cast(sum(balance) over (order by balance desc, address rows unbounded preceding) as double) / cast(sum(balance) over () as double) as cum_share from holders"""))
def _(t):
    scan = ordered_scan(t.holders, [("balance", True), ("address", False)], {"c": "balance"}, totals={"_s": "c"})
    return scan.select("address", B.safe_div("c", "_s").alias("cum_share"))


@report("e14_share_in_partition", sql("ord", f", {DAILY} select symbol, day, cast(v as double) / cast(sum(v) over (partition by day) as double) as x from d"))
def _(t):
    return daily(t).select("symbol", "day", W.share("v", ["day"]).alias("x"))


_window_report(
    "e15_any_recent", "max(case when v > 1500 then 1 else 0 end) over (partition by symbol order by day rows 7 preceding)",
    lambda: W.any_recent(F.when(F.col("v") > 1500, 1).otherwise(0), ["symbol"], "day", 7),
)


@report("e16_rolling_full", sql("ord", f""", {DAILY}
    select symbol, day, cast(v as double) as v, case when count(*) over x = 7 then cast(sum(v) over x as double) end as sum_7, case when count(*) over x = 7 then cast(sum(v) over x as double) / 7 end as mean_7,
           case when count(*) over y = 30 then cast(sum(v) over y as double) end as sum_30, case when count(*) over y = 30 then cast(sum(v) over y as double) / 30 end as mean_30
    from d window x as (partition by symbol order by day rows 6 preceding), y as (partition by symbol order by day rows 29 preceding)"""))
def _(t):
    return rolling(daily(t), ["symbol"], "day", "v")


# -- sorts, limits, set operations -------------------------------------------


@report("f01_order_by", sql("ord", "select symbol, day, cast(sum(amount) as double) as v from ord group by all order by 2 desc, 1"))
def _(t):
    return daily(t).orderBy(F.col("day").desc(), "symbol")


@report("f02_last_n", sql("ord", "select day, cast(sum(amount) as double) as v from ord group by day order by day desc limit 7"))
def _(t):
    return t.orders.groupBy("day").agg(F.sum("amount").alias("v")).orderBy(F.col("day").desc()).limit(7)


@report("f03_top_n_share", sql("holders", """
    select cast(sum(balance) filter (where r <= 10) as double) / cast(sum(balance) as double) as top_share from (select balance, row_number() over (order by balance desc, address) as r from holders)"""))
def _(t):
    return top_stakes(t.holders).select("top_share")


@report("f04_union_all", sql("transfers", "select to_addr as a, event_id from transfers union all select from_addr, event_id from transfers"))
def _(t):
    return stack(t.transfers.select(F.col("to_addr").alias("a"), "event_id"), t.transfers.select(F.col("from_addr").alias("a"), "event_id"))


@report("f05_union_distinct", sql("transfers", "select to_addr as a from transfers union select from_addr from transfers"))
def _(t):
    return stack(t.transfers.select(F.col("to_addr").alias("a")), t.transfers.select(F.col("from_addr").alias("a"))).distinct()


@report("f06_append_new_keys", sql("prices ord", """,
    a as (select symbol, day, cast(price as double) as price from prices), b as (select symbol, day, cast(max(amount) as double) as price from ord group by all)
    select * from a union all select * from b where (symbol, day) not in (select symbol, day from a)"""))
def _(t):
    other = t.orders.groupBy("symbol", "day").agg(F.max("amount").cast("double").alias("price"))
    return T.stitch(t.prices.select("symbol", "day", B.dbl("price").alias("price")), other, ["symbol", "day"])


# -- densification -----------------------------------------------------------


@report("g01_spine", sql("ord", """
    select cast(d as date) as period, count(o_orderkey) as n from generate_series(timestamp '1995-01-01', timestamp '2001-08-01', interval 1 month) g(d)
    left join ord on cast(date_trunc('month', day) as date) = cast(d as date) group by all"""))
def _(t):
    per = t.orders.groupBy(F.to_date(F.date_trunc("month", "day")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return T.spine(t.spark, "1995-01-01", "2001-08-01", "1 month", "period").join(per, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@report("g02_entity_spine", sql("ev event_days", "select f.address, d.day from (select address, min(day) as f from ev group by address) f join event_days d on d.day >= f.f"))
def _(t):
    return T.entity_spine(t.ev, ["address"], "day", EVENTS_AS_OF)


DENSE = """
    , f as (select address, min(day) as f from ev group by address), s as (select address, day, sum(value) as v from ev group by all),
    g as (select f.address, d.day, s.v from f join event_days d on d.day >= f.f left join s on s.address = f.address and s.day = d.day)"""


@report("g03_densify", sql("ev event_days", DENSE + "select address, day, cast(coalesce(v, 0) as double) as value from g"))
def _(t):
    return T.densify(t.ev, ["address"], "day", ["value"], EVENTS_AS_OF)


LOCF = sql("ev event_days", DENSE + "select address, day, cast(last_value(v ignore nulls) over (partition by address order by day rows unbounded preceding) as double) as value from g")


@report("g04_locf", LOCF)
def _(t):
    return T.locf(T.densify(t.ev, ["address"], "day", ["value"], EVENTS_AS_OF, fill=None), ["address"], "day", ["value"])


@report("g05_fill_by_group", LOCF)
def _(t):
    g = T.densify(t.ev, ["address"], "day", ["value"], EVENTS_AS_OF, fill=None).withColumnRenamed("value", "v")
    return T.fill_by_group(g, ["address"], "day", "v", "value").drop("v")


POOLS = ["P0", "P1", "P2", "P3", "P4"]


@report("g06_wide_fill", sql("ev event_hours", """
    , h as (select date_trunc('hour', ts) as day, pool as symbol, cast(max(value) as double) as v from ev where event_type = 'click' group by all)
    select day, """ + ", ".join(f"last_value(max(v) filter (where symbol = '{p}') ignore nulls) over (order by day rows unbounded preceding) as {p}" for p in POOLS) + " from h group by day"))
def _(t):
    h = t.of_type("click").groupBy(F.date_trunc("hour", "ts").alias("day"), F.col("pool").alias("symbol")).agg(F.max("value").cast("double").alias("v"))
    return wide_filled(h, POOLS, "v")


@report("g07_step_function", sql("ev event_days", """,
    s as (select pool, day, cast(max(value) as double) as v from ev where event_type = 'click' and value > 100 group by all),
    c as (select *, lead(day, 1, date '2024-02-01') over (partition by pool order by day) as nxt from s)
    select pool, d.day, v from c join event_days d on d.day >= c.day and d.day < nxt"""))
def _(t):
    c = t.of_type("click").where("value > 100").groupBy("pool", "day").agg(F.max("value").alias("v"))
    return T.expand_intervals(T.step_intervals(c, ["pool"], "day", EVENTS_AS_OF), "day", "next_day", "day")


@report("g08_closing", sql("ev", "select pool, date_trunc('hour', ts) as hour, arg_max(cast(value as double), event_id) as value from ev group by all"))
def _(t):
    return T.closing(t.ev.withColumn("hour", F.date_trunc("hour", "ts")), ["pool", "hour"], ["value"], ["ts", "event_id"])


@report("g09_explode_ticks", sql("lpc", """
    select pool, tick, cast(sum(sgn * value) as double) as liquidity from (select *, unnest(generate_series(tick_lower, tick_upper - 1, 60)) as tick from lpc) group by all"""))
def _(t):
    rows = lp_events(t).select("pool", "tick_lower", "tick_upper", (F.col("sgn") * F.col("value")).alias("v"))
    per = rows.groupBy("pool", "tick_lower", "tick_upper").agg(F.sum("v").alias("v"))  # one row per range before ticks are made
    return T.explode_ticks(per, "tick_lower", "tick_upper", 60).groupBy("pool", "tick").agg(F.sum("v").alias("liquidity"))


@report("g10_stitch", sql("ev event_prices", """,
    r as (select pool as symbol, day, cast(max(value) as double) as price from ev where value > 150 group by all)
    select * from r union all select symbol, day, cast(price as double) from event_prices p where not exists (select 1 from r where r.symbol = p.symbol and r.day = p.day)"""))
def _(t):
    first = t.ev.where("value > 150").groupBy(F.col("pool").alias("symbol"), "day").agg(F.max("value").cast("double").alias("price"))
    return T.stitch(first, t.event_prices.select("symbol", "day", B.dbl("price").alias("price")), ["symbol", "day"])


@report("g11_downsample", sql("ev", """,
    h as (select pool, date_trunc('hour', ts) as hour, cast(sum(value) as double) as v from ev group by all)
    select pool, cast(hour as date) as day, round(avg(v), 9) as v, max(v) as hi from h group by all"""))
def _(t):
    h = t.ev.groupBy("pool", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").cast("double").alias("v"))
    return rnd(T.downsample(h, ["pool"], "hour", {"v": F.avg("v"), "hi": F.max("v")}), 9, "v")


# -- former row functions ----------------------------------------------------


@report("h02_lp_positions_as_of", sql("lp_pos", "select * from lp_pos"))
def _(t):
    return lp_share(t.transfers, "P2", "P1", "0x00000005", before="2024-01-03")


def lp_functions(t):
    view = f"ledger_{uuid.uuid4().hex}"
    t.transfers.createOrReplaceTempView(view)
    create_lp_positions(t.spark, view)


@report("h02_lp_positions_as_of_sql", sql("lp_pos", "select * from lp_pos"))
def _(t):
    lp_functions(t)
    return t.spark.sql("select * from lp_positions_as_of('P2', 'P1', '0x00000005', date '2024-01-03')")


@report("h01_lp_positions_sql", sql("signed", """,
    s as (select token, holder, sum(amount) as amount from signed where token = 'P2' or (token = 'P1' and holder = '0x00000005') group by all)
    select 'P2/P1' as pool, holder, cast(amount as double) / cast((select -sum(amount) from s where token = 'P2' and holder = '0x00000000') as double)
                   * cast((select sum(amount) from s where token = 'P1' and holder = '0x00000005') as double) as position
    from s where token = 'P2' and holder <> '0x00000000' and amount > 0.01"""))
def _(t):
    lp_functions(t)
    return t.spark.sql("select 'P2/P1' as pool, holder, position from lp_positions('P2', 'P1', '0x00000005') where position is not null")


@report("h04_row_functions", sql("props", "select proposal_id, category, cast(result as bigint) as result from props"))
def _(t):
    return cleaned(t).select("proposal_id", "category", "result")


@report("h03_hex_to_number", sql("ord", "select o_orderkey, cast(o_orderkey * 1000000007 as double) as x from ord"))
def _(t):
    return t.orders.select("o_orderkey", B.hex_to_number(F.hex(F.col("o_orderkey") * 1000000007)).alias("x"))


@report("h03_hex_to_number_exact", sql("ord", f"""
    , x as (select symbol, cast('{2**200}' as bignum) + cast(o_orderkey * 1000000007 as bignum) as v from ord)
    select symbol, sum(v)::varchar as total, max(v)::varchar as high, min(v)::varchar as low, (max(v) - min(v))::varchar as spread from x group by symbol"""))
def _(t):
    word = F.concat(F.lit("1"), F.lpad(F.hex(F.col("o_orderkey") * 1000000007), 50, "0"))
    g = t.orders.select("symbol", U.from_hex(word).alias("v")).groupBy("symbol").agg(U.total("v").alias("total"), F.max("v").alias("high"), F.min("v").alias("low"))
    return g.withColumn("spread", U.subtract("high", "low")).select("symbol", *[U.to_text(c).alias(c) for c in ("total", "high", "low", "spread")])


@report("h05_count_true", sql("winning", "select category, count(*) filter (where is_deciding_vote = 'Was Deciding Voter') as n from winning group by category"))
def _(t):
    return winning(t).groupBy("category").agg(A.count_if(F.col("is_deciding_vote") == DECIDING[0]).alias("n"))


# -- incremental roll-up -----------------------------------------------------


@report("s01_stream_daily_sums", sql("ev", "select day, event_type, cast(sum(value) as double) as value, count(*) as n from ev group by all"))
def _(t):
    static = t.raw("events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    out, chk = scratch_path(t.spark, "daily"), scratch_path(t.spark, "daily-chk")
    stream = D.event_stream(t.spark, t.path, t.raw("events"), "events.parquet").withColumn("value", F.col("value").cast("decimal(18,2)"))
    D.append_closed_days(D.daily_sums(stream, "ts", ["event_type"], "value"), out, chk)
    live = D.daily_sums(static, "ts", ["event_type"], "value")
    history = t.spark.read.schema(live.schema).parquet(out)
    return D.with_open_days(history, live)


@report("s02_stream_late_events", sql("ev", "select day, event_type, cast(sum(value) as double) as value, count(*) as n from ev group by all"))
def _(t):
    store, chk = scratch_path(t.spark, "merged-days"), scratch_path(t.spark, "merged-days-chk")
    stream = D.event_stream(t.spark, t.path, t.raw("events"), "events.parquet").withColumn("value", F.col("value").cast("decimal(18,2)"))
    D.merge_days(stream, "ts", ["event_type"], "value", store, chk)
    return D.merged_days(t.spark, store, ["event_type"], "value")
