"""Promotion analysis: who bought, what they did with the tokens, what they earn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalar import dbl, safe_div, to_int
from .aggregates import count_if
from .joins import running_total, scalar_join
from .ledger import signed_ledger


def bought_in_window(ledger: DataFrame, seller: str, token: str, start: str, end: str) -> DataFrame:
    """Units each holder received from the seller in [start, end)."""
    hit = (F.col("from_addr") == seller) & (F.col("token") == token) & (F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date"))
    return ledger.where(hit).groupBy(F.col("to_addr").alias("holder")).agg(F.sum("value").alias("bought"))


def promo_summary(ledger: DataFrame, reward_txs: DataFrame, not_from: str, seller: str, token: str, start: str, end: str) -> DataFrame:
    """One row: airdropped addresses and amount, buying addresses and amount."""
    drops = ledger.where(F.col("from_addr") != not_from).join(reward_txs.select("tx_hash").distinct(), "tx_hash", "left_semi")
    dropped = drops.agg(F.countDistinct("to_addr").alias("airdrop_addresses"), F.sum("value").alias("airdropped"))
    buys = bought_in_window(ledger, seller, token, start, end)
    return scalar_join(dropped, buys.agg(F.count(F.lit(1)).alias("buyers"), F.sum("bought").alias("bought")))


def wallet_balance_before(ledger: DataFrame, token: str, before: str) -> DataFrame:
    rows = signed_ledger(ledger.where((F.col("token") == token) & (F.col("day") < F.lit(before).cast("date"))))
    return rows.groupBy("holder").agg(F.sum("amount").alias("amount"))


def buyer_segments(bought: DataFrame, wallet: DataFrame, lp: DataFrame, big: float = 250) -> DataFrame:
    """Prior balance (wallet plus pool shares) per buyer, with the size of each segment on every row."""
    lp_sum = lp.groupBy("holder").agg(F.sum("amount").alias("lp"))
    zero = F.lit(0.0)
    j = bought.join(wallet.select("holder", dbl("amount").alias("w")), "holder", "left").join(lp_sum, "holder", "left")
    rows = j.select(
        "holder", to_int(F.coalesce("w", zero) + F.coalesce(dbl("lp"), zero)).alias("total_amount"),
        to_int(F.coalesce("w", zero)).alias("in_wallet"), to_int(F.coalesce(dbl("lp"), zero)).alias("in_pools"), to_int("bought").alias("bought"),
    )
    total = F.col("total_amount")
    sizes = rows.agg(
        count_if(total >= big).alias("big_holders"), count_if((total < big) & (total > 0)).alias("small_holders"),
        count_if(total == 0).alias("new_holders"), F.sum(F.when(total == 0, F.col("bought")).otherwise(0)).alias("new_bought"),
    )
    return scalar_join(rows, sizes)


def capped(out: Column, running: Column, cap: Column) -> Column:
    """Part of an outflow that still falls on the capped units."""
    return F.when(running <= cap, out).otherwise(F.greatest(cap - running + out, F.lit(0)))


def capped_outflow_daily(bought: DataFrame, outs: DataFrame) -> DataFrame:
    """Outflow per day charged to the bought units, and the share of them not yet gone.

    Outflows are whole units per holder and day; a holder is charged until its
    bought units are used up.
    """
    b = bought.select("holder", to_int("bought").alias("bought"))
    per = outs.groupBy("holder", "day").agg(to_int(F.sum("amount")).alias("out"))
    j = per.join(b, "holder")
    run = W.running_sum("out", ["holder"], "day")
    day = j.withColumn("_r", run).groupBy("day").agg(F.sum(capped(F.col("out"), F.col("_r"), F.col("bought"))).alias("charged"))
    total = b.agg(F.sum("bought").alias("_t"))
    out = scalar_join(day.withColumn("cum_charged", W.running_sum("charged", [], "day")), total)
    return out.select("day", "charged", "cum_charged", safe_div(F.col("_t") - F.col("cum_charged"), "_t").alias("retention_rate"))


def capped_outflow_events(bought: DataFrame, outs: DataFrame) -> DataFrame:
    """The same per transfer (holder, ts, day, tx_hash, amount), in time order."""
    b = bought.select("holder", to_int("bought").alias("bought"))
    rows = outs.withColumn("out", to_int("amount")).join(b, "holder")
    run = running_total(rows, ["holder"], ["ts", "tx_hash"], "out", "_r", F.date_trunc("minute", "ts"))
    return run.withColumn("charged", capped(F.col("out"), F.col("_r"), F.col("bought"))).where("charged <> 0").select(
        "holder", "day", "tx_hash", "bought", "out", "charged"
    )


def disposition(charged: DataFrame, sold: DataFrame, staked: DataFrame, pooled: DataFrame) -> DataFrame:
    """Charged outflow split by what else its transaction did: sold, staked, pooled, other."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("tx_hash").distinct().withColumn(name, F.lit(True))

    per_tx = charged.groupBy("tx_hash").agg(F.sum("charged").alias("c"))
    j = per_tx.join(flag(sold, "s"), "tx_hash", "left").join(flag(staked, "k"), "tx_hash", "left").join(flag(pooled, "p"), "tx_hash", "left")

    def part(name: str) -> Column:
        return F.sum(F.when(F.col(name), F.col("c")).otherwise(0))

    sums = j.agg(part("s").alias("sold"), part("k").alias("staked"), part("p").alias("pooled"), F.sum("c").alias("total"))
    return sums.withColumn("other", F.col("total") - F.col("sold") - F.col("staked") - F.col("pooled"))


def follow_on(ledger: DataFrame, rewarded: DataFrame, swap_txs: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Purchases of the listed tokens by rewarded addresses inside swap transactions."""
    got = ledger.where(F.col("token").isin(*tokens)).select("tx_hash", "token", F.col("to_addr").alias("address"), F.col("value").alias("amount"))
    got = got.join(rewarded.select("address").distinct(), "address", "left_semi").join(swap_txs.select("tx_hash").distinct(), "tx_hash", "left_semi").distinct()
    per = got.groupBy("token").agg(F.countDistinct("address").alias("buyers"), F.sum("amount").alias("amount"))
    return scalar_join(per, got.agg(F.countDistinct("address").alias("all_buyers")))


def promo_rewards(
    buys: DataFrame, sells: DataFrame, reward_price: DataFrame, start: str, hold_days: int = 7, rate: float = 0.05, floor: float = 10.0
) -> DataFrame:
    """Reward per wallet: volume bought, cut pro rata when it was sold again within the hold time.

    buys / sells have (wallet, ts, volume, usd). Sells count from the wallet's
    first buy on. ``reward_price`` has the price samples to average.
    """
    b = buys.where(F.col("ts") >= F.lit(start).cast("timestamp")).groupBy("wallet").agg(
        F.min("ts").alias("first_buy"), F.max("ts").alias("last_buy"), F.sum("volume").alias("buy_volume"), F.sum("usd").alias("buy_usd")
    )
    later = sells.join(b.select("wallet", "first_buy"), "wallet").where(F.col("ts") >= F.col("first_buy"))
    s = later.groupBy("wallet").agg(F.min("ts").alias("first_sell"), F.sum("volume").alias("sell_volume"))
    j = b.join(s, "wallet", "left")
    held = (dbl(F.unix_micros("first_sell")) - dbl(F.unix_micros("last_buy"))) / F.lit(86400e6)
    usd = dbl("buy_usd")
    eligible = F.when(held.isNull() | (held >= hold_days), usd).otherwise(usd - usd * safe_div("sell_volume", "buy_volume"))
    price = reward_price.agg((F.sum("price").cast("double") / F.count("price")).alias("_p"))
    rows = scalar_join(j.withColumn("eligible_usd", eligible).where(F.col("eligible_usd") >= floor), price)
    reward = F.col("eligible_usd") * F.lit(rate)
    return rows.select("wallet", "eligible_usd", reward.alias("usd_reward"), (reward / F.col("_p")).alias("units_reward"))
