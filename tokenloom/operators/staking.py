"""Staking pools: yield, estimated rewards, staker behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import dbl, safe_div
from .joins import scalar_join
from .ordering import ordered_scan
from .timeseries import step_intervals


def reward_schedule(days: DataFrame, schedule: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Daily reward by date; ranges are half open and the first that fits counts."""
    out = None
    for begin, stop, daily in schedule:
        hit = (F.col("day") >= F.lit(begin).cast("date")) & (F.col("day") < F.lit(stop).cast("date"))
        out = F.when(hit, F.lit(float(daily))) if out is None else out.when(hit, F.lit(float(daily)))
    return days.withColumn("daily_reward", out)


def staking_apr(staked: DataFrame, reward_price: DataFrame, base_price: DataFrame, reserves: DataFrame, lp_total: DataFrame, rewards: DataFrame) -> DataFrame:
    """Staked pool tokens, their dollar price, yearly rate and reward per token, per day.

    staked (day, balance); prices (day, price); reserves (day, base) at day
    end; lp_total (day, minted); rewards (day, daily_reward).
    """
    b = staked.withColumn("change", F.col("balance") - W.previous("balance", [], "day"))
    j = (
        b.join(reward_price.select("day", dbl("price").alias("reward_price")), "day", "left")
        .join(base_price.select("day", dbl("price").alias("base_price")), "day", "left")
        .join(reserves.select("day", dbl("base").alias("base_reserve")), "day", "left")
        .join(lp_total.select("day", dbl("minted").alias("lp_total")), "day", "left").join(rewards, "day", "left")
    )
    tvl = F.col("base_price") * (F.col("base_reserve") * 2)
    j = j.withColumn("tvl", tvl).withColumn("lp_usd", safe_div("tvl", "lp_total"))
    value = dbl("balance") * F.col("lp_usd")
    return j.withColumns({
        "apr": safe_div(F.col("reward_price") * F.col("daily_reward"), value) * 365 * 100, "reward_per_lp": safe_div("daily_reward", "balance"),
    })


def stake_moves(ledger: DataFrame, contracts: Sequence[str], lp_token: str) -> DataFrame:
    """Stakes (+) and withdrawals (-) per staker; equal moves are all kept."""
    to_pool, from_pool = F.col("to_addr").isin(*contracts), F.col("from_addr").isin(*contracts)
    rows = ledger.where((F.col("token") == lp_token) & (to_pool | from_pool))
    legs = F.array(
        F.when(to_pool, F.struct(F.col("from_addr").alias("address"), F.col("value").alias("amount"))),
        F.when(from_pool, F.struct(F.col("to_addr").alias("address"), (-F.col("value")).alias("amount"))),
    )
    return rows.select("day", F.explode(F.filter(legs, lambda x: x.isNotNull())).alias("l")).select("day", "l.address", "l.amount")


def staker_rewards(moves: DataFrame, per_lp: DataFrame, as_of: str) -> DataFrame:
    """Current stake, days with a stake and estimated rewards per staker.

    Reward of a stake interval = stake x (prefix sum at its end - at its
    start), so no staker x day rows are made. per_lp: (day, reward_per_lp).
    """
    daily = moves.groupBy("address", "day").agg(F.sum("amount").alias("c"))
    run = daily.select("address", "day", W.running_sum("c", ["address"], "day").alias("balance"))
    iv = step_intervals(run, ["address"], "day", as_of)
    # prefix sums over the calendar: reward and number of rated days before each day;
    # days on which a stake changes are added so that both ends of an interval are found
    zero, none = F.lit(0), F.lit(0.0)
    rated = per_lp.select("day", F.coalesce(F.col("reward_per_lp"), none).alias("r"), F.lit(1).alias("n"))
    ends = [iv.select(F.col(c).alias("day")).distinct().select("day", none.alias("r"), zero.alias("n")) for c in ("day", "next_day")]
    per_day = stack(rated, *ends).groupBy("day").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    before = W.over([], "day").rowsBetween(Window.unboundedPreceding, -1)
    pre = per_day.select("day", F.coalesce(F.sum("r").over(before), none).alias("r"), F.coalesce(F.sum("n").over(before), zero).alias("n"))
    j = iv.join(pre, "day").join(pre.select(F.col("day").alias("next_day"), F.col("r").alias("r2"), F.col("n").alias("n2")), "next_day")
    span, rate = F.col("n2") - F.col("n"), F.col("r2") - F.col("r")
    return j.groupBy("address").agg(
        F.max_by("balance", "day").alias("balance"), F.sum(F.when(F.col("balance") > 0, span).otherwise(zero)).alias("days_earned"),
        F.sum(dbl("balance") * rate).alias("rewards_earned"),
    )


def staker_behaviour(rewards: DataFrame, ledger: DataFrame, contracts: Sequence[str], reward_token: str) -> DataFrame:
    """Claims, transfers after the first claim, type and rank by stake per staker."""
    tok = ledger.where(F.col("token") == reward_token)
    claims = tok.where(F.col("from_addr").isin(*contracts)).groupBy(F.col("to_addr").alias("address")).agg(
        F.min("ts").alias("first_claim"), (-F.sum("value")).alias("claimed")
    )
    later = (
        tok.select(F.col("from_addr").alias("address"), "ts", "value").join(claims.select("address", "first_claim"), "address")
        .where(F.col("ts") >= F.col("first_claim")).groupBy("address").agg(F.sum("value").alias("moved"))
    )
    j = rewards.join(claims.drop("first_claim"), "address", "left").join(later, "address", "left")
    zero = F.lit(0)
    j = j.withColumns({"claimed": F.coalesce("claimed", zero), "moved": F.coalesce("moved", zero)})
    j = j.withColumn("account_type", F.when(F.col("moved") == 0, F.lit("Holder")).otherwise(F.lit("Seller")))
    return ordered_scan(j, [("balance", True), ("address", False)], position="lp_rank")


def staker_summary(behaviour: DataFrame, top: int = 10) -> DataFrame:
    """Concentration in the largest stakes, and outstanding rewards by account type; one row."""
    due = F.col("rewards_earned") + dbl("claimed")
    big = F.col("lp_rank") <= top
    s = behaviour.agg(
        F.sum(F.when(big, F.col("balance")).otherwise(0)).cast("double").alias("top_balance"), F.sum("balance").cast("double").alias("total_staked"),
        F.sum(due).alias("outstanding"), F.sum(F.when(F.col("account_type") == "Holder", due).otherwise(0.0)).alias("outstanding_holders"),
        F.sum(F.when(F.col("account_type") == "Seller", due).otherwise(0.0)).alias("outstanding_sellers"),
    )
    return s.withColumn("top_share", safe_div(F.col("top_balance") * 100, "total_staked"))


def top_stakes(stakes: DataFrame, n: int = 10) -> DataFrame:
    """Share of the n largest stakes, without ranking the others."""
    top = stakes.orderBy(F.col("balance").desc(), "address").limit(n).agg(F.sum("balance").cast("double").alias("top_balance"))
    return scalar_join(top, stakes.agg(F.sum("balance").cast("double").alias("total"))).withColumn("top_share", safe_div("top_balance", "total"))
