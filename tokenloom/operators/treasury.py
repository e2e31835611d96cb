"""Treasury balances and flows, vesting, asset backing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalar import ZERO, dbl, safe_div
from .aggregates import sum_if
from .joins import scalar_join
from .ledger import daily_change, signed_ledger
from .timeseries import expand_intervals, spine, step_intervals

Keys = Sequence[str]


def wallet_changes(ledger: DataFrame, wallets: DataFrame) -> DataFrame:
    """Daily change per (token, holder) of the listed wallets only."""
    mine = wallets.select(F.col("address").alias("holder")).distinct()
    return daily_change(signed_ledger(ledger).join(mine, "holder", "left_semi"))


def token_balance_daily(change: DataFrame, as_of: str) -> DataFrame:
    """Balance of all wallets together per token and day.

    The wallets' changes are added before the running sum, so the work is
    tokens x calendar and not wallets x calendar.
    """
    per = change.groupBy("token", "day").agg(F.sum("change").alias("c"))
    run = per.select("token", "day", W.running_sum("c", ["token"], "day").alias("balance"))
    return expand_intervals(step_intervals(run, ["token"], "day", as_of), "day", "next_day", "day")


def _with_price(df: DataFrame, prices: DataFrame) -> DataFrame:
    return df.join(prices.select(F.col("symbol").alias("token"), "day", dbl("price").alias("price")), ["token", "day"], "left")


def treasury_over_time(change: DataFrame, prices: DataFrame, unit: str, start: str, end: str) -> DataFrame:
    """Mean dollar value per token and period between two days."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    bal = token_balance_daily(change.where(F.col("day") <= last), end).where(F.col("day") >= first)
    usd = _with_price(bal, prices.where(F.col("day").between(first, last))).withColumn("usd", dbl("balance") * F.coalesce("price", F.lit(0.0)))
    return usd.groupBy(F.to_date(F.date_trunc(unit, "day")).alias("period"), "token").agg(F.avg("usd").alias("avg_usd_value"))


def treasury_current(change: DataFrame, prices: DataFrame, end: str, by: Keys = ("token",)) -> DataFrame:
    """Balance and dollar value on the end day per token, or per wallet and token.

    A balance on a day is the sum of the changes up to it. Tokens without a
    price that day are kept and count zero dollars, so both forms have one total.
    """
    day = F.lit(end).cast("date")
    bal = change.where(F.col("day") <= day).groupBy(*by).agg(F.sum("change").alias("balance")).withColumn("day", day)
    j = _with_price(bal, prices)
    return j.select(*by, "balance", (dbl("balance") * F.coalesce("price", F.lit(0.0))).alias("usd_value"))


def flows_weekly(ledger: DataFrame, wallets: DataFrame, prices: DataFrame) -> DataFrame:
    """Weekly inflow and outflow per token in units and dollars, and the running value."""
    mine = wallets.select(F.col("address").alias("holder")).distinct()
    legs = signed_ledger(ledger).join(mine, "holder", "left_semi")
    per = legs.groupBy("token", "day", "holder", (F.col("amount") > 0).alias("inward")).agg(F.sum("amount").alias("a"))
    j = _with_price(per, prices)
    usd = dbl("a") * F.coalesce("price", F.lit(0.0))
    week = j.groupBy("token", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(
        F.avg("price").alias("avg_price"), F.coalesce(sum_if(F.col("inward"), "a"), F.lit(0)).alias("inflow"),
        F.coalesce(sum_if(~F.col("inward"), "a"), F.lit(0)).alias("outflow"),
        F.coalesce(sum_if(F.col("inward"), usd), F.lit(0.0)).alias("inflow_usd"), F.coalesce(sum_if(~F.col("inward"), usd), F.lit(0.0)).alias("outflow_usd"),
    )
    total = W.running_sum(F.col("inflow") + F.col("outflow"), ["token"], "week")
    return week.withColumn("balance_usd", F.col("avg_price") * dbl(total))


def flows_by_recipient(ledger: DataFrame, wallets: DataFrame, prices: DataFrame, aliases: DataFrame, contributors: Keys) -> DataFrame:
    """Monthly outflow per recipient and token; listed contributors share one category.

    ``aliases`` (address, alias) is made unique per address, so a repeated row
    does not repeat the flow.
    """
    mine = wallets.select(F.col("address").alias("from_addr")).distinct()
    out = ledger.join(mine, "from_addr", "left_semi")
    per = out.groupBy("token", "day", "from_addr", F.col("to_addr").alias("recipient")).agg(F.sum("value").alias("a"))
    j = _with_price(per, prices)
    month = j.groupBy(F.to_date(F.date_trunc("month", "day")).alias("month"), "recipient", "token").agg(
        F.avg("price").alias("avg_price"), F.sum("a").alias("amount"), F.sum(dbl("a") * F.coalesce("price", F.lit(0.0))).alias("amount_usd")
    )
    names = aliases.groupBy(F.col("address").alias("recipient")).agg(F.min("alias").alias("alias"))
    m = month.join(names, "recipient", "left")
    kind = F.when(F.col("recipient").isin(*contributors), F.lit("Contributor Rewards")).otherwise(F.coalesce("alias", F.lit("unknown")))
    return m.select("month", "recipient", "token", "avg_price", "amount", "amount_usd", kind.alias("category"))


def backing(current: DataFrame, ledger: DataFrame, unit: str, assets: Keys, treasury: str, locked: Keys) -> DataFrame:
    """Dollar assets of the treasury wallet per total and circulating unit; one row.

    ``current`` is :func:`treasury_current` by (holder, token).
    """
    lock = F.col("holder").isin(*locked) & (F.col("token") == unit)
    held = current.agg(
        *[F.coalesce(sum_if((F.col("holder") == treasury) & (F.col("token") == a), "usd_value"), F.lit(0.0)).alias(f"usd_{a}") for a in assets],
        F.coalesce(sum_if(lock, "balance"), F.lit(0)).cast("double").alias("locked"),
    )
    mint, burn = F.col("from_addr") == ZERO, F.col("to_addr") == ZERO
    rows = ledger.where((F.col("token") == unit) & (mint != burn))
    total = rows.agg(F.sum(F.when(mint, F.col("value")).otherwise(-F.col("value"))).cast("double").alias("total_supply"))
    j = scalar_join(held, total)
    usd = sum((F.col(f"usd_{a}") for a in assets[1:]), F.col(f"usd_{assets[0]}"))
    circ = F.col("total_supply") - F.col("locked")
    return j.withColumns({"circulating": circ, "usd_per_total": safe_div(usd, "total_supply"), "usd_per_circulating": safe_div(usd, circ)})


def vesting(schedule: DataFrame, claims: DataFrame, start: str, end: str) -> DataFrame:
    """Granted so far, claimed so far and available per day.

    schedule: (begin, finish, daily), both days included, without overlap;
    claims: (day, amount).
    """
    spark = schedule.sparkSession
    days = spine(spark, start, end)
    grants = expand_intervals(schedule.select(F.col("begin"), F.date_add("finish", 1).alias("stop"), "daily"), "begin", "stop", "day")
    per = grants.groupBy("day").agg(F.sum("daily").alias("g"))
    got = claims.groupBy("day").agg(F.sum("amount").alias("c"))
    j = days.join(per, "day").join(got, "day", "left")
    zero = F.lit(0)
    granted, claimed = W.running_sum("g", [], "day"), W.running_sum(F.coalesce("c", zero), [], "day")
    return j.select("day", granted.alias("granted"), claimed.alias("claimed")).withColumn("available", F.col("granted") - F.col("claimed"))
