"""Basket composition, net asset value, leverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import dbl, safe_div
from .joins import scalar_join
from .timeseries import closing


def composition(mints: DataFrame, legs: DataFrame, bucket: str, order: Sequence[str]) -> DataFrame:
    """Component units per basket unit, from the last mint of each time bucket.

    mints: (tx_hash, bucket, quantity, order columns); legs: (tx_hash,
    component, amount) of tokens that went into the basket.
    """
    last = closing(mints, [bucket], ["tx_hash", "quantity"], order)
    j = legs.join(last, "tx_hash")
    per = j.groupBy(bucket, "tx_hash", "component").agg(F.sum("amount").alias("a"), F.max("quantity").alias("q"))
    return per.select(bucket, "component", safe_div("a", "q").alias("units"))


def membership(comp: DataFrame, bucket: str, as_of: str) -> DataFrame:
    """In and out time per component; those in the last mint stay until ``as_of``."""
    span = comp.groupBy("component").agg(F.min(bucket).alias("in_time"), F.max(bucket).alias("last_time"))
    end = comp.agg(F.max(bucket).alias("_end"))
    kind = dict(comp.dtypes)[bucket]
    out = F.when(F.col("last_time") < F.col("_end"), F.col("last_time")).otherwise(F.lit(as_of).cast(kind))
    return scalar_join(span, end).select("component", "in_time", out.alias("out_time"))


def basket_nav(comp: DataFrame, prices: DataFrame, bucket: str, as_of: str, step: str = "1 day") -> DataFrame:
    """Sum over member components of last known price times last known units, per calendar step.

    prices: (component, bucket, price), one row per component and time; all
    buckets lie on the calendar of ``step``. A component's value changes only
    where its price or units do, so it is an interval until its next row, and
    a step without a trade counts with the price before it. Members without
    any price so far do not count.
    """
    kind, none, one = dict(prices.dtypes)[bucket], F.lit(None).cast("double"), F.expr(f"interval {step}")
    seen = stack(
        prices.select("component", bucket, dbl("price").alias("price"), none.alias("units")),
        comp.select("component", bucket, none.alias("price"), dbl("units").alias("units")),
    ).groupBy("component", bucket).agg(F.max("price").alias("price"), F.max("units").alias("units"))
    known = seen.select(
        "component", bucket, (W.last_known("price", ["component"], bucket) * W.last_known("units", ["component"], bucket)).alias("v"),
        W.following(bucket, ["component"], bucket).alias("_next"),
    ).where(F.col("v").isNotNull())
    spans = known.join(membership(comp, bucket, as_of), "component").select(
        "v", F.greatest(bucket, "in_time").alias("_from"), F.least((F.col("_next") - one).cast(kind), F.col("out_time")).alias("_to")
    ).where(F.col("_from") <= F.col("_to"))
    return spans.select("v", F.explode(F.sequence("_from", "_to", one)).alias(bucket)).groupBy(bucket).agg(F.sum("v").alias("nav"))


def nav_vs_market(nav: DataFrame, market: DataFrame, bucket: str, since: str | None = None) -> DataFrame:
    """Market price with the basket value of the same time."""
    m = market.select(bucket, dbl("price").alias("market_price"))
    if since is not None:
        m = m.where(F.col(bucket) >= F.lit(since).cast(dict(market.dtypes)[bucket]))
    return m.join(nav, bucket, "left")


def premium_discount(nav: DataFrame, market: DataFrame, bucket: str, ma: int = 12) -> DataFrame:
    """(Smoothed) market price over basket value, as a share of the value; ma=1 means unsmoothed."""
    px = market.select(bucket, W.moving_avg("price", [], bucket, ma - 1).alias("market_price"))
    j = nav.join(px, bucket, "left").where(F.col("nav").isNotNull() & F.col("market_price").isNotNull())
    return j.withColumn("premium", safe_div(F.col("market_price") - F.col("nav"), "nav"))


def carry_together(series: Sequence[DataFrame], keys: Sequence[str], hour: str, cols: Sequence[str]) -> DataFrame:
    """Hourly series side by side with gaps carried, as rows of the first series' hours.

    One union and one aggregation align them all; the as-of lookup is a
    forward fill on an hour grid, which the calendar bounds.
    """
    first = series[0].select(*keys, hour).distinct().withColumn("_on", F.lit(True))
    parts = []
    for df in [first, *series]:
        missing = [c for c in [*cols, "_on"] if c not in df.columns]
        kinds = {"_on": "boolean"}
        parts.append(df.withColumns({c: F.lit(None).cast(kinds.get(c, "double")) for c in missing}).select(*keys, hour, "_on", *[dbl(c).alias(c) for c in cols]))
    wide = stack(*parts).groupBy(*keys, hour).agg(F.max("_on").alias("_on"), *[F.max(c).alias(c) for c in cols])
    filled = wide.withColumns({c: W.last_known(c, list(keys), hour) for c in cols})
    return filled.where("_on").drop("_on")


def leverage_ratio(balances: DataFrame, debt: DataFrame, collateral_px: DataFrame, debt_px: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Collateral value over debt value per hour.

    balances: (keys, hour, collateral, reward); debt: (keys, hour, debt);
    prices: (keys, hour, collateral_usd) and (keys, hour, debt_usd).
    """
    cols = ["collateral", "reward", "debt", "collateral_usd", "debt_usd"]
    j = carry_together([balances, debt, collateral_px, debt_px], keys, "hour", cols)
    a, d = F.col("collateral") * F.col("collateral_usd"), F.col("debt") * F.col("debt_usd")
    return j.withColumns({"assets": a, "liabilities": d, "leverage_ratio": safe_div(a, d)})


def leveraged_nav(lev: DataFrame, supply: DataFrame, market: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Value per unit at the last hour of each day against the market price of that hour.

    supply: (keys, hour, units); market: (keys, hour, price).
    """
    k = list(keys)
    nav = lev.withColumn("net_assets", F.col("assets") - F.col("liabilities")).where(F.col("net_assets").isNotNull())
    last = closing(nav.withColumn("day", F.to_date("hour")), [*k, "day"], ["hour", "net_assets"], ["hour"])
    j = last.join(supply, [*k, "hour"], "left").join(market.select(*k, "hour", dbl("price").alias("market_price")), [*k, "hour"], "left")
    return j.select(*k, "day", "hour", "net_assets", safe_div("net_assets", "units").alias("net_nav"), "market_price")


def vs_underlying(px: DataFrame, v2: DataFrame, v3: DataFrame, bucket: str, period: Column, name: str, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Product price as the mean of the venues that traded, next to the underlying's price.

    px: (bucket, price); v2 / v3: (keys, bucket, ratio) with product per base.
    The source averages over all v2 x v3 rows of a bucket; those means are
    formed from sums per bucket, the pairs are not.
    """
    k = list(keys)
    a = v2.groupBy(*k, bucket).agg(F.sum("ratio").alias("s2"), F.count("ratio").alias("n2"))
    b = v3.groupBy(*k, bucket).agg(F.sum("ratio").alias("s3"), F.count("ratio").alias("n3"))
    j = a.join(px.select(bucket, dbl("price").alias("p")), bucket).join(b, [*k, bucket], "left")
    many = F.greatest(F.coalesce(F.col("n3"), F.lit(0)), F.lit(1))
    rows = F.col("n2") * many
    g = j.groupBy(*k, period.alias(name)).agg(
        safe_div(F.sum(F.col("s2") * many), F.sum(rows)).alias("r2"),
        safe_div(F.sum(F.col("s3") * F.col("n2")), F.sum(F.col("n3") * F.col("n2"))).alias("r3"),
        safe_div(F.sum(F.col("p") * rows), F.sum(rows)).alias("underlying"),
    )
    one = F.lit(1.0)
    p2, p3 = safe_div(one, "r2") * F.col("underlying"), safe_div(one, "r3") * F.col("underlying")
    zero = F.lit(0.0)
    n = F.when(p2.isNotNull(), one).otherwise(zero) + F.when(p3.isNotNull(), one).otherwise(zero)
    return g.select(*k, name, safe_div(F.coalesce(p2, zero) + F.coalesce(p3, zero), n).alias("product_price"), "underlying")


def rebalance(pools: DataFrame) -> DataFrame:
    """Balances after weights change and arbitrage settles, in closed form per pool.

    pools: (pool, idx, balance, weight, spot); the first token (smallest idx)
    is the unit of account, ``spot`` is the market price of the others in it.
    """
    first = F.min("idx").alias("_first")
    heads = pools.groupBy("pool").agg(first, F.min_by("weight", "idx").alias("_w1"))
    rows = pools.join(heads, "pool").withColumn("_other", F.col("idx") != F.col("_first"))
    w = dbl("weight")
    rest = F.when(F.col("_other"), w * F.log(dbl("spot") * F.col("_w1") / w)).otherwise(F.lit(0.0))
    log_b1 = rows.groupBy("pool").agg(F.sum(w * F.log(dbl("balance")) + rest).alias("_l"))
    b1 = F.exp("_l")
    out = F.when(F.col("_other"), b1 / dbl("spot") * w / F.col("_w1")).otherwise(b1)
    return rows.join(log_b1, "pool").select("pool", "idx", "balance", out.alias("new_balance"))
