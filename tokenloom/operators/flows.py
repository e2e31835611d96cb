"""Net inflows, growth since launch, trading volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalar import dbl, safe_div
from .aggregates import count_if, sum_if
from .timeseries import spine


def flows(issuance: DataFrame, price: DataFrame) -> DataFrame:
    """AUM and net inflow in dollars per (symbol, day)."""
    p = dbl("price")
    return issuance.join(price, ["symbol", "day"], "left").select(
        "symbol", "day", (dbl("supply") * p).alias("aum"), (dbl("net") * p).alias("net_inflow")
    )


def net_flow_ma(fl: DataFrame, short: int = 7, long: int = 28) -> DataFrame:
    def ma(c: str, n: int):
        return W.moving_avg(c, ["symbol"], "day", n - 1)

    return fl.withColumns({
        "ma_short": ma("net_inflow", short), "ma_long": ma("net_inflow", long),
        "ma_long_rate": safe_div(ma("net_inflow", long), ma("aum", long)),
    })


def net_flow_total(fl: DataFrame, long: int = 28) -> DataFrame:
    """Sum over products of the long trailing mean."""
    return net_flow_ma(fl, long=long).groupBy("day").agg(F.sum("ma_long").alias("av"))


def cumulative_flow(fl: DataFrame) -> DataFrame:
    return fl.withColumn("cum_inflow", W.running_sum("net_inflow", ["symbol"], "day"))


def cum_flow_vs_aum(fl: DataFrame, days: DataFrame) -> DataFrame:
    """All products: running inflow against AUM per calendar day."""
    t = cumulative_flow(fl).groupBy("day").agg(F.sum("aum").alias("aum"), F.sum("cum_inflow").alias("cum_inflow"))
    return days.join(t, "day", "left")


def flow_growth(
    fl: DataFrame, products: DataFrame, denom: str = "cum_inflow", smooth: int | None = 14, min_days: int | None = None, every: int | None = None, n: int = 7
) -> DataFrame:
    """Trailing n-day inflow over the denominator n days before, by days since launch.

    ``smooth`` is the half width of a centred mean; ``every`` keeps one row per
    that many days.
    """
    c = cumulative_flow(fl).join(products.select("symbol", "inception"), "symbol", "left")
    rate = safe_div(W.moving_sum("net_inflow", ["symbol"], "day", n - 1), W.previous(denom, ["symbol"], "day", n))
    g = c.select("symbol", "day", F.datediff("day", "inception").alias("days_since_launch"), rate.alias("growth"))
    if smooth:
        g = g.withColumn("growth", W.moving_avg("growth", ["symbol"], "day", smooth, smooth))
    if min_days is not None:
        g = g.where(F.col("days_since_launch") >= min_days)
    if every:
        g = g.where(F.pmod("days_since_launch", F.lit(every)) == 0).withColumn(
            "week", F.floor(F.col("days_since_launch") / F.lit(every))
        )
    return g


def flow_by_period(fl: DataFrame, products: DataFrame, start: str, as_of: str, unit: str = "week") -> DataFrame:
    """Net inflow per product and calendar period; periods without flow stay NULL."""
    per = fl.groupBy("symbol", F.to_date(F.date_trunc(unit, "day")).alias("period")).agg(F.sum("net_inflow").alias("net_inflow"))
    grid = products.select("symbol").crossJoin(F.broadcast(spine(fl.sparkSession, start, as_of, f"1 {unit}", "period")))
    return grid.join(per, ["symbol", "period"], "left")


def trading_volume(trades: DataFrame, prices: DataFrame, products: Sequence[str], preceding: int = 7) -> DataFrame:
    """Dollar volume per product and day with a trailing mean over the days that traded."""
    product = F.when(F.col("token_a").isin(*products), F.col("token_a")).when(F.col("token_b").isin(*products), F.col("token_b"))
    rows = trades.withColumn("product", product).where(F.col("product").isNotNull())
    once = rows.select("tx_hash", "trace", "evt_index", "product", "day", "minute", "token_a", "amount_a", "token_b", "amount_b").distinct()
    # equal trades are gone, so amounts are added first and few rows meet the prices, once for both sides
    sums = once.groupBy("product", "day", "minute", "token_a", "token_b").agg(F.sum("amount_a").alias("a"), F.sum("amount_b").alias("b"))
    quoted = prices.groupBy("minute").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "price"))).alias("_p"))  # one entry a base asset
    own, other = F.col("_p")[F.col("token_a")], F.col("_p")[F.col("token_b")]
    usd = sums.join(quoted, "minute").withColumn("usd", F.coalesce(F.col("a") * own, F.col("b") * other))
    v = usd.where("usd is not null").groupBy("product", "day").agg(F.sum("usd").alias("usd_volume"))
    return v.withColumn("av", W.moving_avg("usd_volume", ["product"], "day", preceding))


def trading_volume_total(volume: DataFrame, preceding: int = 7) -> DataFrame:
    t = volume.groupBy("day").agg(F.sum("usd_volume").alias("volume"))
    return t.withColumn("av", W.moving_avg("volume", [], "day", preceding))


def buys_sells(trades: DataFrame, price: DataFrame, products: Sequence[str]) -> DataFrame:
    """Buys (product on side a) against sells (side b) per day: counts, net, dollar volumes.

    The price is one per day, so amounts are added first and priced once.
    """
    key = ["tx_hash", "trace", "evt_index", "day"]
    side = F.array(
        F.struct(F.lit("buy").alias("way"), F.col("token_a").alias("symbol"), F.col("amount_a").alias("amount")),
        F.struct(F.lit("sell").alias("way"), F.col("token_b").alias("symbol"), F.col("amount_b").alias("amount")),
    )
    rows = trades.select(*key, F.explode(side).alias("s")).select(*key, "s.way", "s.symbol", "s.amount").where(F.col("symbol").isin(*products))
    once = rows.distinct()
    buy, sell = F.col("way") == "buy", F.col("way") == "sell"
    day = once.groupBy("symbol", "day").agg(
        count_if(buy).alias("buys"), count_if(sell).alias("sells"),
        dbl(sum_if(buy, "amount")).alias("b"), dbl(sum_if(sell, "amount")).alias("s"),
    )
    j = day.join(price.select("symbol", "day", dbl("price").alias("p")), ["symbol", "day"])
    b, s = F.coalesce("b", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return j.select(
        "symbol", "day", "buys", "sells", (F.col("buys") - F.col("sells")).alias("net"),
        (F.col("b") * F.col("p")).alias("buy_volume"), (F.col("s") * F.col("p")).alias("sell_volume"),
        ((b - s) * F.col("p")).alias("net_volume"), ((b + s) * F.col("p")).alias("total_volume"),
    )
