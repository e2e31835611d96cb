"""Issue and redeem events, unit supply, mint volume.

Event columns: ts, day, tx_hash, symbol, wallet, amount, evt_type, use_type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import dbl
from .timeseries import spine


def _is(kind: str) -> Column:
    return F.col("evt_type") == kind


def signed_amount(amount: str = "amount") -> Column:
    return F.when(_is("Issue"), F.col(amount)).when(_is("Redeem"), -F.col(amount))


def issuance_events(modules: Sequence[tuple[str, DataFrame]], exchange: DataFrame) -> DataFrame:
    """All modules' events; 'Exchange' where the transaction also has an exchange event.

    Exchange hashes are made distinct first: several exchange events in one
    transaction must not repeat the issuance row.
    """
    events = stack(*[df.withColumn("evt_type", F.lit(kind)) for kind, df in modules])
    flag = exchange.select("tx_hash").distinct().withColumn("_x", F.lit(True))
    use = F.when(F.col("_x"), F.lit("Exchange")).otherwise(F.lit("Standard"))
    return events.join(flag, "tx_hash", "left").withColumn("use_type", use).drop("_x")


def _symbol_grid(daily: DataFrame, step_col: str, as_of: str, step: str) -> DataFrame:
    kind = "timestamp" if step.endswith("hour") else "date"
    end = F.lit(as_of).cast(kind)
    return (
        daily.groupBy("symbol").agg(F.min(step_col).alias("_f")).where(F.col("_f") <= end)
        .select("symbol", F.explode(F.sequence("_f", end, F.expr(f"interval {step}"))).alias(step_col))
    )


def _issuance(events: DataFrame, period: Column, name: str, as_of: str, step: str) -> DataFrame:
    sums = events.groupBy("symbol", period.alias(name)).agg(
        F.sum(F.when(_is("Issue"), F.col("amount")).otherwise(F.lit(0))).alias("issued"),
        F.sum(F.when(_is("Redeem"), F.col("amount")).otherwise(F.lit(0))).alias("redeemed"),
    )
    g = _symbol_grid(sums, name, as_of, step).join(sums, ["symbol", name], "left")
    g = g.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("issued", "redeemed")})
    return g.select(
        "symbol", name, "issued", "redeemed",
        (F.col("issued") - F.col("redeemed")).alias("net"),
        (F.col("issued") + F.col("redeemed")).alias("gross"),
        W.running_sum(F.col("issued") - F.col("redeemed"), ["symbol"], name).alias("supply"),
    )


def issuance_daily(events: DataFrame, as_of: str) -> DataFrame:
    """Issued, redeemed, net, gross and running supply per symbol on every day."""
    return _issuance(events, F.col("day"), "day", as_of, "1 day")


def issuance_hourly(events: DataFrame, as_of: str) -> DataFrame:
    """The same per hour; amounts of one hour are added up."""
    return _issuance(events, F.date_trunc("hour", "ts"), "hour", as_of, "1 hour")


def unit_supply(events: DataFrame, start: str, as_of: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Running mint minus burn on every day from ``start``; ``by=()`` gives the total."""
    daily = events.groupBy(*by, "day").agg(F.sum(signed_amount()).alias("d"))
    days = spine(events.sparkSession, start, as_of)
    grid = daily.select(*by).distinct().crossJoin(F.broadcast(days)) if by else days
    g = grid.join(daily, [*by, "day"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return g.select(*by, "day", W.running_sum_peers("d", list(by), "day").alias("units"))


def supply_and_moves(events: DataFrame, start: str, as_of: str) -> DataFrame:
    """Unit supply and issued plus redeemed amount per symbol on every day from ``start``, in one scan of the events.

    Days are made from the steps of the supply, so no grid of symbols is read first.
    """
    first, stop = F.lit(start).cast("date"), F.date_add(F.lit(as_of).cast("date"), 1)
    daily = events.where((F.col("day") >= first) & (F.col("day") < stop)).groupBy("symbol", "day").agg(
        F.sum(signed_amount()).alias("net"), F.sum("amount").alias("gross")
    )
    w = W.over(["symbol"], "day")
    steps = daily.select(
        "symbol", "day", "gross", W.running_sum("net", ["symbol"], "day").alias("units"),
        F.lead("day", 1).over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first"),
    )
    none = F.lit(0)
    own = F.struct(F.col("day").alias("_a"), F.coalesce("_next", stop).alias("_z"), "units", "gross")
    before = F.struct(first.alias("_a"), F.col("day").alias("_z"), none.cast(steps.schema["units"].dataType).alias("units"), none.cast(steps.schema["gross"].dataType).alias("gross"))
    pieces = steps.select("symbol", F.explode(F.when(F.col("_first"), F.array(before, own)).otherwise(F.array(own))).alias("p")).select("symbol", "p.*").where("_a < _z")
    days = pieces.select("symbol", "_a", "units", "gross", F.explode(F.sequence(F.col("_a"), F.date_sub("_z", 1), F.expr("interval 1 day"))).alias("day"))
    return days.select("symbol", "day", "units", F.when(F.col("day") == F.col("_a"), F.col("gross")).otherwise(none).alias("gross"))


def mint_volume(events: DataFrame, start: str, as_of: str, preceding: int = 7, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Issued amount per day with a trailing mean over ``preceding + 1`` rows."""
    daily = events.where(_is("Issue")).groupBy(*by, "day").agg(F.sum("amount").alias("amount"))
    days = spine(events.sparkSession, start, as_of)
    grid = daily.select(*by).distinct().crossJoin(F.broadcast(days)) if by else days
    g = grid.join(daily, [*by, "day"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)))
    return g.withColumn("av", W.moving_avg("amount", list(by), "day", preceding))


def mint_redeem(daily: DataFrame, price: DataFrame, preceding: int = 7) -> DataFrame:
    """Mint, redeem (negative) and net in units and dollars with trailing means.

    ``daily`` is :func:`issuance_daily`; the mean follows the calendar day.
    """
    p = dbl("price")
    d = daily.join(price, ["symbol", "day"], "left").select(
        "symbol", "day", F.col("issued").alias("mint_volume"), (-F.col("redeemed")).alias("redeem_volume"),
        F.col("net").alias("net_volume"), (dbl("issued") * p).alias("mint_usd"), (-dbl("redeemed") * p).alias("redeem_usd"),
        (dbl("net") * p).alias("net_usd"),
    )
    return d.withColumns({"av": W.moving_avg("net_volume", ["symbol"], "day", preceding), "av_usd": W.moving_avg("net_usd", ["symbol"], "day", preceding)})


def issuance_type(events: DataFrame, price: DataFrame, start: str, as_of: str) -> DataFrame:
    """Standard and exchange issuance in dollars with six running columns."""
    names = ["std_mint", "std_redeem", "std_net", "exchange_mint", "exchange_redeem", "exchange_net"]
    std = F.col("use_type") == "Standard"

    def pick(use: Column, amount: Column) -> Column:
        return F.sum(F.when(use, amount).otherwise(F.lit(0)))

    signed = signed_amount()
    issue = F.when(_is("Issue"), F.col("amount"))
    redeem = F.when(_is("Redeem"), -F.col("amount"))
    daily = events.groupBy("symbol", "day").agg(
        pick(std, issue).alias("std_mint"), pick(std, redeem).alias("std_redeem"), pick(std, signed).alias("std_net"),
        pick(~std, issue).alias("exchange_mint"), pick(~std, redeem).alias("exchange_redeem"), pick(~std, signed).alias("exchange_net"),
    )
    grid = daily.select("symbol").distinct().crossJoin(F.broadcast(spine(events.sparkSession, start, as_of)))
    usd = (
        grid.join(daily, ["symbol", "day"], "left").join(price, ["symbol", "day"], "left")
        .select("symbol", "day", *[(F.coalesce(dbl(n), F.lit(0.0)) * dbl("price")).alias(f"{n}_usd") for n in names])
    )
    return usd.withColumns({f"cum_{n}": W.running_sum(f"{n}_usd", ["symbol"], "day") for n in names})
