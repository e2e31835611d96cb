"""Liquidity positions, pool reserves, price impact, supply breakdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import ZERO, dbl, safe_div, sqrt_price, tick_price, to_int
from .aggregates import with_total
from .joins import asof_last, previous_row, running_totals, scalar_join
from .ledger import signed_ledger
from .timeseries import closing, expand_intervals, spine, step_intervals

POSITION = ["address", "pool"]


def pools_for(factory: DataFrame, tokens: DataFrame, focal: Sequence[str]) -> DataFrame:
    """Pools with a focal token on either side, with symbol and precision of both sides."""
    def side(n: int) -> DataFrame:
        return tokens.select(F.col("address").alias(f"token{n}"), F.col("symbol").alias(f"symbol{n}"), F.col("decimals").alias(f"decimals{n}"))

    hit = F.col("token0").isin(*focal) | F.col("token1").isin(*focal)
    return factory.where(hit).join(side(0), "token0").join(side(1), "token1")


def lp_share(ledger: DataFrame, lp_token: str, token: str, pair: str, mint_from: str = ZERO, before: str | None = None, dust: float = 0.01) -> DataFrame:
    """Each holder's share of a pool's token balance, optionally as of a day.

    Both the share tokens and the pool's balance come from one aggregation of
    the signed ledger.
    """
    rows = signed_ledger(ledger if before is None else ledger.where(F.col("day") < F.lit(before).cast("date")))
    lp, bal = F.col("token") == lp_token, (F.col("token") == token) & (F.col("holder") == pair)
    sums = rows.where(lp | bal).groupBy("token", "holder").agg(F.sum("amount").alias("amount"))
    totals = sums.agg(
        (-F.sum(F.when(lp & (F.col("holder") == mint_from), F.col("amount")))).cast("double").alias("_lp"),
        F.sum(F.when(bal, F.col("amount"))).cast("double").alias("_bal"),
    )
    held = sums.where(lp & (F.col("holder") != mint_from) & (F.col("amount") > dust))
    return scalar_join(held, totals).select("holder", (dbl("amount") / F.col("_lp") * F.col("_bal")).alias("position"))


def position_intervals(changes: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """Open positions with their day ranges from (keys, day, amount) changes."""
    daily = changes.groupBy(*keys, "day").agg(F.sum("amount").alias("change"))
    run = daily.withColumn("amount", W.running_sum("change", keys, "day")).drop("change")
    return step_intervals(run, keys, "day", as_of).where(F.col("amount") > 0)


def closing_prices(swaps: DataFrame, order: Sequence[str], as_of: str) -> DataFrame:
    """Last swap price per pool and day, carried over days without swaps up to ``as_of``."""
    close = closing(swaps, ["pool", "day"], ["price"], order)
    return expand_intervals(step_intervals(close, ["pool"], "day", as_of), "day", "next_day", "day")


def v2_swap_price(in0: str, out0: str, in1: str, out1: str) -> Column:
    bought1 = (F.col(in0) > 0) & (F.col(out1) > 0)
    return F.when(bought1, safe_div(out1, in0)).otherwise(safe_div(in1, out0))


def lp_exposure_v2(changes: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """Token amounts behind constant-product positions per address, pool and day.

    ``changes`` has amount = ±amount0 * amount1 per move.
    """
    open_ = expand_intervals(position_intervals(changes, POSITION, as_of), "day", "next_day", "day")
    j = open_.join(prices, ["pool", "day"])
    k, p = dbl("amount"), dbl("price")
    return j.select(*POSITION, "day", "price", F.sqrt(k / p).alias("amount0"), F.sqrt(k * p).alias("amount1"))


def lp_exposure_v3(changes: DataFrame, prices: DataFrame, as_of: str, d0: int = 0, d1: int = 0) -> DataFrame:
    """Token amounts behind concentrated positions: below, inside or above the tick range."""
    keys = [*POSITION, "tick_lower", "tick_upper"]
    open_ = expand_intervals(position_intervals(changes, keys, as_of), "day", "next_day", "day")
    j = open_.join(prices, ["pool", "day"])
    sp, sl, su = F.sqrt(dbl("price")), F.sqrt(tick_price("tick_lower", d0, d1)), F.sqrt(tick_price("tick_upper", d0, d1))
    liq, zero = dbl("amount"), F.lit(0.0)
    below, above = F.col("price") < tick_price("tick_lower", d0, d1), F.col("price") > tick_price("tick_upper", d0, d1)
    return j.select(
        *keys, "day", "price", F.when(below, "below").when(above, "above").otherwise("between").alias("in_range"),
        F.when(above, zero).when(below, liq / sl - liq / su).otherwise(liq / sp - liq / su).alias("amount0"),
        F.when(below, zero).when(above, liq * su - liq * sl).otherwise(liq * sp - liq * sl).alias("amount1"),
    )


def lending_exposure(changes: DataFrame, as_of: str) -> DataFrame:
    """Running supplied minus redeemed per address on every day from the first move."""
    daily = changes.groupBy("address", "day").agg(F.sum("amount").alias("change"))
    run = daily.withColumn("exposure", W.running_sum("change", ["address"], "day")).drop("change")
    return expand_intervals(step_intervals(run, ["address"], "day", as_of), "day", "next_day", "day")


def total_exposure(parts: Sequence[DataFrame]) -> DataFrame:
    """Sum over wallet, pools and lending per (address, day)."""
    return stack(*parts).groupBy("address", "day").agg(F.sum("exposure").alias("exposure"))


def exposed_holders(exposure: DataFrame) -> DataFrame:
    """Addresses above zero per day; ``exposure`` already has one row per (address, day)."""
    return exposure.where("exposure > 0").groupBy("day").agg(F.count(F.lit(1)).alias("holders"))


def lp_wallet_summary(lp: DataFrame, kinds: Sequence[str], wallet: DataFrame) -> DataFrame:
    """Wallet and pool holdings per holder that has any pool position."""
    wide = lp.groupBy("holder").pivot("kind", list(kinds)).agg(F.sum("position")).na.fill(0.0, list(kinds))
    j = wide.join(wallet.select("holder", to_int("balance").alias("w")), "holder", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    pooled = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return j.select("holder", (F.col("w") + pooled).alias("balance"), F.col("w").alias("in_wallet"), pooled.alias("in_pools"), *kinds)


def reserves_v2(sync: DataFrame, pools: DataFrame, prices: DataFrame, bucket: str = "minute") -> DataFrame:
    """Mean reserves per pool and day and their dollar value.

    Reserves are added per price bucket before prices are joined.
    pools: (pool, token0, token1); prices: (bucket, symbol, price).
    """
    sums = sync.groupBy("pool", "day", bucket).agg(F.sum(dbl("reserve0")).alias("r0"), F.sum(dbl("reserve1")).alias("r1"), F.count(F.lit(1)).alias("n"))
    j = _priced(sums.join(pools.select("pool", "token0", "token1"), "pool"), prices, bucket, "inner")
    return j.groupBy("pool", "day").agg(
        safe_div(F.sum("r0"), F.sum("n")).alias("reserve0"), safe_div(F.sum("r1"), F.sum("n")).alias("reserve1"),
        safe_div(F.sum(F.col("r0") * F.col("p0") + F.col("r1") * F.col("p1")), F.sum("n")).alias("reserves_usd"),
    )


def _priced(df: DataFrame, prices: DataFrame, bucket: str, how: str) -> DataFrame:
    for n in (0, 1):
        p = prices.select(bucket, F.col("symbol").alias(f"token{n}"), dbl("price").alias(f"p{n}"))
        df = df.join(p, [bucket, f"token{n}"], how)
    return df


def reserves_v3(moves: Sequence[DataFrame], pools: DataFrame, prices: DataFrame, bucket: str = "minute") -> DataFrame:
    """Mean dollar reserves per pool and day from running mint - burn + swap amounts.

    ``moves`` are signed (pool, ts, day, bucket, amount0, amount1) rows. A
    union and a sum stand in for the three-way full join.
    """
    per = stack(*moves).groupBy("pool", "ts", "day", bucket).agg(F.sum("amount0").alias("a0"), F.sum("amount1").alias("a1"))
    run = running_totals(per, ["pool"], ["ts"], {"r0": "a0", "r1": "a1"}, F.col("day"))
    sums = run.groupBy("pool", "day", bucket).agg(F.sum(dbl("r0")).alias("r0"), F.sum(dbl("r1")).alias("r1"), F.count(F.lit(1)).alias("n"))
    j = _priced(sums.join(pools.select("pool", "token0", "token1"), "pool"), prices, bucket, "left")
    usd = F.col("r0") * F.col("p0") + F.col("r1") * F.col("p1")
    return j.groupBy("pool", "day").agg(safe_div(F.sum(usd), F.sum(F.when(usd.isNotNull(), F.col("n")))).alias("reserves_usd"))


def reserves_compare(v2: DataFrame, v3: DataFrame) -> DataFrame:
    cols = ["pool", "day", "reserves_usd"]
    return stack(v3.select(*cols).withColumn("version", F.lit("v3")), v2.select(*cols).withColumn("version", F.lit("v2")))


def _ticks_upto(x: Column, lower: Column, step: int, n: Column) -> Column:
    """How many of the ticks lower, lower + step, ... are <= x (at most n)."""
    return F.least(n, F.greatest(F.lit(0), F.floor((x - lower) / F.lit(float(step))) + 1))


def _ticks_below(x: Column, lower: Column, step: int, n: Column) -> Column:
    """How many are < x."""
    return F.least(n, F.greatest(F.lit(0), F.ceil((x - lower) / F.lit(float(step)))))


def liquidity_bands(changes: DataFrame, prices: DataFrame, step: int, seconds: int, quote_scale: float = 1.0) -> DataFrame:
    """Liquidity above, below and near the price per pool and time bucket.

    changes: (pool, tick_lower, tick_upper, bucket, amount); prices: (pool,
    bucket, price). Ranges hold ticks from lower to upper, both included; how
    many of them fall in a band is counted in closed form, so no tick rows are
    made. A tick t stands for the price quote_scale / 1.0001^t.
    """
    keys = ["pool", "tick_lower", "tick_upper"]
    per = changes.groupBy(*keys, "bucket").agg(F.sum("amount").alias("c"))
    run = per.withColumns({"amount": W.running_sum("c", keys, "bucket"), "_next": W.following("bucket", keys, "bucket")}).where("amount > 0")
    every = F.expr(f"interval {seconds} seconds")
    last = prices.groupBy("pool").agg(F.max("bucket").alias("_last"))
    stop = F.coalesce(F.col("_next") - every, F.col("_last"))
    rows = run.join(last, "pool").withColumn("_stop", stop).where(F.col("bucket") <= F.col("_stop"))
    open_ = rows.select(*keys, "amount", F.explode(F.sequence("bucket", "_stop", every)).alias("bucket"))
    j = open_.join(prices.select("pool", "bucket", dbl("price").alias("price")), ["pool", "bucket"])
    lo = dbl("tick_lower")
    n = (F.floor((F.col("tick_upper") - F.col("tick_lower")) / F.lit(step)) + 1).cast("bigint")
    liq = dbl("amount")

    def at(factor: float) -> Column:
        return F.log(F.lit(quote_scale) / (F.col("price") * F.lit(factor))) / F.log(F.lit(1.0001))

    def between(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), _ticks_upto(b, lo, step, n) - _ticks_below(a, lo, step, n))

    x = at(1.0)
    parts = {"below_price": n - _ticks_upto(x, lo, step, n), "above_price": _ticks_below(x, lo, step, n)}
    for pct in (2, 5, 10):
        f = 1 + pct / 100
        parts[f"minus_{pct}"] = between(x, at(1 / f))
        parts[f"plus_{pct}"] = between(at(f), x)
    sums = j.groupBy("pool", "bucket", "price").agg(*[F.sum(liq * c).alias(k) for k, c in parts.items()])
    total = F.col("above_price") + F.col("below_price")
    out = sums.withColumn("total", total)
    for pct in (2, 5, 10):
        within = F.col(f"minus_{pct}") + F.col(f"plus_{pct}")
        out = out.withColumns({f"within_{pct}": within, f"share_{pct}": safe_div(within, "total")})
    return out


def price_impact_v2(swaps: DataFrame, sync: DataFrame, min_size: float) -> DataFrame:
    """Impact of large swaps against the reserves before them.

    The pool's last reserve event earlier in the same transaction gives the
    reserves after the swap; the swap's amounts are taken back out. Long
    transactions are cut every thousand events of a block.
    """
    cut = F.struct(F.col("block"), F.floor(F.col("idx") / 1000))
    j = asof_last(swaps, sync, ["pool", "tx_hash"], ["block", "idx"], ["reserve0", "reserve1"], cut, inclusive=False)
    j = j.where(F.col("reserve0").isNotNull() & (F.col("amount0_in") > 0) & (F.abs(F.col("amount1_out") + F.col("amount1_in")) > min_size))
    before = safe_div(F.col("reserve1") + F.col("amount1_out"), F.col("reserve0") - F.col("amount0_in"))
    paid = safe_div(F.col("amount1_out") + F.col("amount1_in"), F.col("amount0_in") + F.col("amount0_out"))
    size = F.abs(F.col("amount1_out") + F.col("amount1_in"))
    return j.select("pool", "ts", F.lit("v2").alias("version"), dbl(size).alias("size"), F.abs(safe_div(paid - before, before) * 100).alias("price_impact"))


def price_impact_v3(swaps: DataFrame, min_size: float, d0: int = 0, d1: int = 0) -> DataFrame:
    """Impact of large swaps: price paid against the price after the large swap before."""
    s = swaps.where(F.abs(F.col("amount1")) > min_size).withColumns({
        "paid": safe_div(F.abs(F.col("amount1")), F.abs(F.col("amount0"))), "after": sqrt_price("sqrt_x96", d0, d1),
    })
    s = previous_row(s, ["pool"], ["block", "idx"], [("after", "before")], F.floor(F.col("block") / 1000))
    return s.select(
        "pool", "ts", F.lit("v3").alias("version"), dbl(F.abs(F.col("amount1"))).alias("size"),
        F.abs(safe_div(F.col("paid") - F.col("before"), "before") * 100).alias("price_impact"),
    )


def token_liquidity(reserves: DataFrame, pools: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollar liquidity per token, venue and day: twice the own side, or twice the other if unpriced."""
    j = _priced(reserves.join(pools.select("pool", "venue", "token0", "token1"), "pool"), prices, "day", "left")
    own0, own1 = F.col("reserve0") * F.col("p0") * 2, F.col("reserve1") * F.col("p1") * 2
    sides = F.array(
        F.struct(F.col("token0").alias("token"), F.coalesce(own0, own1).alias("usd")),
        F.struct(F.col("token1").alias("token"), F.coalesce(own1, own0).alias("usd")),
    )
    rows = j.select("day", "venue", F.explode(sides).alias("s"))
    return rows.groupBy("day", "venue", F.col("s.token").alias("token")).agg(F.sum("s.usd").alias("liquidity"))


def staked_share(ledger: DataFrame, lp_token: str, stakers: Sequence[str], start: str, as_of: str) -> DataFrame:
    """Running staked pool tokens over running minted pool tokens per day."""
    rows = signed_ledger(ledger.where(F.col("token") == lp_token))
    minted = -F.sum(F.when(F.col("holder") == ZERO, F.col("amount")))
    staked = F.sum(F.when(F.col("holder").isin(*stakers), F.col("amount")))
    daily = rows.groupBy("day").agg(minted.alias("m"), staked.alias("s"))
    g = spine(ledger.sparkSession, start, as_of).join(daily, "day", "left")
    zero = F.lit(0)
    run = g.select(
        "day", W.running_sum_peers(F.coalesce("m", zero), [], "day").alias("minted"), W.running_sum_peers(F.coalesce("s", zero), [], "day").alias("staked")
    )
    return run.withColumn("share", F.coalesce(safe_div("staked", "minted"), F.lit(0.0)))


def supply_breakdown(
    total: DataFrame, liquidity: DataFrame, optional: DataFrame, share: DataFrame, rewards: DataFrame, price: DataFrame, preceding: int = 7
) -> DataFrame:
    """Units per product and day split into incentivised, unincentivised and pooled, with values.

    total (symbol, day, units); liquidity / optional (symbol, day, reserves);
    share (day, share); rewards (symbol, day, amount); price (symbol, day, price).
    """
    keys = ["symbol", "day"]
    avg = rewards.groupBy(*keys).agg(F.sum("amount").alias("a")).withColumn("avg_rewarded", W.moving_avg("a", ["symbol"], "day", preceding)).drop("a")
    j = (
        total.join(liquidity.select(*keys, F.col("reserves").alias("liquidity")), keys, "left")
        .join(optional.select(*keys, F.col("reserves").alias("optional_liquidity")), keys, "left")
        .join(share.select("day", "share"), "day", "left").join(avg, keys, "left").join(price.select(*keys, dbl("price").alias("price")), keys, "left")
    )
    inc = F.col("optional_liquidity") * F.col("share")
    free = dbl("units") - inc
    return j.select(
        *keys, dbl("units").alias("total"), inc.alias("incentivized"), free.alias("unincentivized"), "liquidity", "optional_liquidity", "share",
        F.coalesce("avg_rewarded", F.lit(0.0)).alias("avg_rewarded"), (dbl("units") * F.col("price")).alias("tvl"), (inc * F.col("price")).alias("itvl"),
        (free * F.col("price")).alias("utvl"), (F.col("liquidity") * F.col("price")).alias("liquidity_value"), "price",
    )


def supply_breakdown_total(detail: DataFrame) -> DataFrame:
    """Detail rows and one row per day for all products together."""
    return with_total(detail, "symbol", ["day"], ["tvl", "itvl", "utvl", "liquidity_value"], "Total")
