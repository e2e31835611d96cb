"""Assets under management, fees, partner shares, operating profit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import dbl, month_label
from .joins import scd_join


def aum(supply: DataFrame, price: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Units times price per (symbol, day); a fallback price fills days without one."""
    out = supply.join(price.select("symbol", "day", dbl("price").alias("price")), ["symbol", "day"], "left")
    if fallback is not None:
        alt = fallback.select("symbol", "day", dbl("price").alias("_alt"))
        out = out.join(alt, ["symbol", "day"], "left").withColumn("price", F.coalesce("price", "_alt")).drop("_alt")
    return out.withColumn("aum", dbl("units") * F.col("price"))


def revenue_daily(issuance: DataFrame, price: DataFrame, fees: DataFrame) -> DataFrame:
    """Streaming and issue/redeem fees by the fee row valid on the day, split with the partner."""
    p = dbl("price")
    base = issuance.join(price, ["symbol", "day"], "left").select(
        "symbol", "day",
        F.coalesce(dbl("supply") * p, F.lit(0.0)).alias("aum"),
        F.coalesce(dbl("issued") * p, F.lit(0.0)).alias("issued_usd"),
        F.coalesce(dbl("redeemed") * p, F.lit(0.0)).alias("redeemed_usd"),
    )
    j = scd_join(base, fees, ["symbol"], "day", "begin_date", "end_date")
    streaming = F.col("aum") * (F.col("streaming_fee") / F.lit(365.0))
    moves = F.col("issued_usd") * F.col("issue_fee") + F.col("redeemed_usd") * F.col("redeem_fee")
    return j.select(
        "symbol", "day", "partner", "partner_split",
        streaming.alias("streaming_revenue"), moves.alias("issue_redeem_revenue"), (streaming + moves).alias("total_revenue"),
        ((streaming + moves) * (F.lit(1.0) - F.col("partner_split"))).alias("net_revenue"),
        ((streaming + moves) * F.col("partner_split")).alias("partner_fee"),
    )


def revenue_const(funds: DataFrame, issuance: DataFrame | None, rate: Mapping[str, float], move_fee: Mapping[str, float], preceding: int = 7) -> DataFrame:
    """Daily revenue from constant rates: streaming on AUM, and a fee on minted plus redeemed units.

    ``funds`` may bring the moved units as ``gross``; else they are joined from ``issuance``.
    """
    def lookup(rates: Mapping[str, float]):
        pairs = [x for k, v in rates.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.coalesce(F.create_map(*pairs)[F.col("symbol")], F.lit(0.0))

    if issuance is None:
        j = funds.withColumn("gross", dbl("gross"))
    else:
        j = funds.join(issuance.select("symbol", "day", dbl("gross").alias("gross")), ["symbol", "day"], "left")
    streaming = F.col("aum") * lookup(rate) / F.lit(365.0)
    moves = F.coalesce(F.col("gross") * F.col("price") * lookup(move_fee), F.lit(0.0))
    out = j.select("symbol", "day", "aum", streaming.alias("streaming"), moves.alias("mint_redeem"), (streaming + moves).alias("revenue"))
    return out.withColumn("av", W.moving_avg("revenue", ["symbol"], "day", preceding))


def revenue_split(rev: DataFrame) -> DataFrame:
    """Running streaming, mint/redeem and total revenue."""
    cols = {"streaming": "cum_streaming", "mint_redeem": "cum_mint_redeem", "revenue": "cum_revenue"}
    return rev.select("symbol", "day", *cols).withColumns({n: W.running_sum(c, ["symbol"], "day") for c, n in cols.items()})


def revenue_cumulative(rev: DataFrame, value: str = "revenue") -> DataFrame:
    return rev.select("symbol", "day", W.running_sum_peers(value, ["symbol"], "day").alias("cum_revenue"))


def revenue_total(rev: DataFrame, value: str = "revenue", preceding: int = 7) -> DataFrame:
    """All products per day with a trailing mean of the sums."""
    day = rev.groupBy("day").agg(F.sum(value).alias("revenue"))
    return day.withColumn("av", W.moving_avg("revenue", [], "day", preceding))


def partner_revenue(rev: DataFrame, value: str = "total_revenue") -> DataFrame:
    return rev.groupBy("day", "partner").agg(F.sum(value).alias("revenue"))


def partner_rewards(rev: DataFrame, pot: float, value: str = "total_revenue") -> DataFrame:
    """Each partner's share of the month's revenue, paid pro rata from a fixed pot."""
    m = rev.groupBy(month_label("day").alias("month"), "partner").agg(F.sum(value).alias("r"))
    part = W.share("r", ["month"])
    return m.select(
        "month", "partner", F.round("r", 2).alias("revenue"), F.round(part, 3).alias("contribution"), F.round(F.lit(pot) * part, 2).alias("reward")
    )


def reward_earnings(deltas: Sequence[DataFrame], price: DataFrame) -> DataFrame:
    """Running dollar value of reward deltas (day, amount) from several sources."""
    day = stack(*deltas).groupBy("day").agg(F.sum("amount").alias("amount"))
    j = day.join(price.select("day", "price"), "day").withColumn("usd", dbl("amount") * dbl("price"))
    return j.select("day", "amount", "usd", W.running_sum_peers("usd", [], "day").alias("cum_usd"))


def tx_costs(tags: Sequence[DataFrame], txs: DataFrame, price: DataFrame) -> DataFrame:
    """Gas cost per day and kind of transaction, in dollars, as negative amounts.

    tags: (tx_hash, kind); txs: (tx_hash, minute, day, gas_price, gas_used);
    price: (minute, price). Tags are counted per transaction before they meet
    it, and gas is added per (minute, kind) before the price is joined.
    """
    counted = stack(*tags).groupBy("tx_hash", "kind").agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("_n"))
    gas = counted.join(txs, "tx_hash")
    eth = gas.groupBy("minute", "day", "kind").agg((F.sum(F.col("gas_price") * F.col("gas_used") * F.col("_n")).cast("double") / F.lit(1e18)).alias("eth"))
    usd = eth.join(price.select("minute", dbl("price").alias("price")), "minute", "left")
    return usd.groupBy("day", F.concat(F.lit("cost - "), F.col("kind")).alias("detail")).agg((-F.sum(F.col("eth") * F.col("price"))).alias("amount"))


def revenue_lines(rev: DataFrame) -> DataFrame:
    """Revenue per day as detail rows."""
    day = rev.groupBy("day").agg(F.sum("streaming").alias("streaming"), F.sum("mint_redeem").alias("mint_redeem"))
    long = day.unpivot(["day"], ["streaming", "mint_redeem"], "detail", "amount")
    return long.select("day", F.concat(F.lit("revenue - "), F.col("detail")).alias("detail"), "amount")


def pnl(revenue: DataFrame, cost: DataFrame, mode: str = "breakdown") -> DataFrame:
    """Profit and loss: ``breakdown`` lines, ``daily`` totals or ``cumulative`` totals."""
    if mode == "breakdown":
        return stack(revenue, cost).distinct()
    r = revenue.groupBy("day").agg(F.sum("amount").alias("revenue"))
    c = cost.groupBy("day").agg(F.sum("amount").alias("cost"))
    zero = F.lit(0.0)
    d = r.join(c, "day", "full").select("day", F.coalesce("revenue", zero).alias("revenue"), F.coalesce("cost", zero).alias("cost"))
    d = d.withColumn("profit", F.col("revenue") + F.col("cost"))
    if mode == "daily":
        return d
    return d.select(
        "day", W.running_sum_peers("revenue", [], "day").alias("revenue"),
        W.running_sum_peers(F.abs(F.col("cost")), [], "day").alias("cost"), W.running_sum_peers("profit", [], "day").alias("profit"),
    )
