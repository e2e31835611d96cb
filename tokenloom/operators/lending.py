"""Money markets: utilisation and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import dbl, safe_div
from .timeseries import closing, expand_intervals, step_intervals


def _daily_accruals(accruals: DataFrame) -> DataFrame:
    """Mean cash, borrows and interest per market and active day."""
    def mean(c: str):
        return (F.sum(c).cast("double") / F.count(c)).alias(c)

    return accruals.groupBy("market", "day").agg(mean("cash"), mean("borrows"), mean("interest"))


def _carried(df: DataFrame, as_of: str) -> DataFrame:
    return expand_intervals(step_intervals(df, ["market"], "day", as_of), "day", "next_day", "day")


def utilisation(balances: DataFrame, accruals: DataFrame, loans: DataFrame, supply: DataFrame, as_of: str) -> DataFrame:
    """Deposits, borrows, utilisation and borrowed value per market and day.

    balances: (market, day, amount, amount_usd); accruals: (market, day, cash,
    borrows, interest); loans: signed (market, day, amount); supply: (day, units).
    Markets report either accruals or single loans; both become daily step
    functions.
    """
    acc = _carried(_daily_accruals(accruals), as_of).select("market", "day", F.col("borrows").alias("borrowed"), (F.col("cash") + F.col("borrows")).alias("pool"))
    per = loans.groupBy("market", "day").agg(F.sum("amount").alias("a"))
    run = per.select("market", "day", dbl(W.running_sum("a", ["market"], "day")).alias("borrowed"))
    lo = _carried(run, as_of).withColumn("pool", F.lit(None).cast("double"))
    j = balances.join(supply.select("day", dbl("units").alias("units")), "day", "left").join(stack(acc, lo), ["market", "day"], "left")
    amount, usd = dbl("amount"), safe_div("amount_usd", "amount")
    return j.select(
        "market", "day", amount.alias("amount"), safe_div(amount, "units").alias("percent_of_supply"), usd.alias("token_usd"), "borrowed",
        safe_div("borrowed", F.coalesce(F.col("pool"), amount + F.col("borrowed"))).alias("utilization"), (F.col("borrowed") * usd).alias("borrowed_usd"),
    )


def lending_apy(accruals: DataFrame, reserve: DataFrame, loans: DataFrame, as_of: str, ray: float = 1e27) -> DataFrame:
    """Supply and borrow rate per market and day.

    Accrual markets: interest over deposits or borrows, times 365. Others:
    the last quoted rates (reserve: market, day, order, rate; loans likewise),
    on days where both are known.
    """
    acc = _carried(_daily_accruals(accruals), as_of)
    year = F.lit(365.0)
    a = acc.select(
        "market", "day", (safe_div("interest", F.col("cash") + F.col("borrows")) * year).alias("supply_rate"),
        F.when(F.col("borrows") == 0, F.lit(0.0)).otherwise(safe_div("interest", "borrows") * year).alias("borrow_rate"),
    )
    s = _carried(closing(reserve, ["market", "day"], ["rate"], ["order"]), as_of).select("market", "day", (dbl("rate") / F.lit(ray)).alias("supply_rate"))
    b = _carried(closing(loans, ["market", "day"], ["rate"], ["order"]), as_of).select("market", "day", (dbl("rate") / F.lit(ray)).alias("borrow_rate"))
    return stack(a, s.join(b, ["market", "day"]).select("market", "day", "supply_rate", "borrow_rate"))
