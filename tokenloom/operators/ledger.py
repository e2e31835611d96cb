"""Transfer ledgers: balances, holders, circulating supply.

Ledger columns: day, token, from_addr, to_addr, value (plus ts, block, idx,
tx_hash where order inside a day matters). Every function adds up per
(token, holder, day) before it sorts or windows, so one busy holder costs at
most one row per day after the first, map-combined shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import ZERO, dbl, to_int
from .aggregates import label_list
from .joins import scalar_join
from .ordering import exact_quantile
from .timeseries import closing, densify, entity_spine, expand_intervals, locf, spine, step_intervals

HOLDER = ["token", "holder"]


def signed_ledger(ledger: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Each transfer as +value to the receiver and -value from the sender; one scan."""
    legs = F.array(
        F.struct(F.col("to_addr").alias("holder"), F.col("value").alias("amount")),
        F.struct(F.col("from_addr").alias("holder"), (-F.col("value")).alias("amount")),
    )
    return ledger.select("token", "day", *extra, F.explode(legs).alias("leg")).select(
        "token", "day", *extra, "leg.holder", "leg.amount"
    )


def daily_change(signed: DataFrame) -> DataFrame:
    return signed.where(F.col("holder") != ZERO).groupBy(*HOLDER, "day").agg(F.sum("amount").alias("change"))


def balance_on_change(change: DataFrame) -> DataFrame:
    """Running balance on the days it moved, and the recency rank of the day."""
    return change.select(
        *HOLDER,
        "day",
        W.running_sum("change", HOLDER, "day").alias("balance"),
        F.row_number().over(W.over(HOLDER, "day", desc=True)).alias("recency"),
    )


def balance_intervals(change: DataFrame, as_of: str) -> DataFrame:
    """Balance with the half-open day range [day, next_day) it was valid in."""
    bal = change.where(F.col("day") <= F.lit(as_of).cast("date")).select(
        *HOLDER, "day", W.running_sum("change", HOLDER, "day").alias("balance")
    )
    return step_intervals(bal, HOLDER, "day", as_of)


def balance_daily(change: DataFrame, as_of: str) -> DataFrame:
    """Balance on every day, by expanding the intervals."""
    return expand_intervals(balance_intervals(change, as_of), "day", "next_day", "day")


def balance_daily_dense(change: DataFrame, as_of: str) -> DataFrame:
    """Same result from a zero-filled day grid and a running sum."""
    grid = densify(change, HOLDER, "day", ["change"], as_of, fill=None)
    return grid.select(*HOLDER, "day", W.running_sum(F.coalesce("change", F.lit(0)), HOLDER, "day").alias("balance"))


def balance_from_snapshots(snap: DataFrame, order: Sequence[str], as_of: str) -> DataFrame:
    """Daily closing balance from snapshot rows (token, holder, day, balance, ...), gaps carried."""
    close = closing(snap, [*HOLDER, "day"], ["balance"], order)
    grid = entity_spine(close, HOLDER, "day", as_of)
    return locf(grid.join(close, [*HOLDER, "day"], "left"), HOLDER, "day", ["balance"])


def balance_latest(change: DataFrame) -> DataFrame:
    """Last balance per holder: the sum of all changes, no window needed."""
    return change.groupBy(*HOLDER).agg(F.sum("change").alias("balance"), F.max("day").alias("last_day"))


def active_count(intervals: DataFrame, group: Sequence[str], start: str, end: str, days: DataFrame) -> DataFrame:
    """Number of intervals open on each day, from +1 / -1 marks and a running sum.

    Output rows are groups x calendar; the intervals are never expanded.
    """
    marks = F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("d")), F.struct(F.col(end).alias("day"), F.lit(-1).alias("d"))))
    delta = intervals.select(*group, marks.alias("m")).groupBy(*group, F.col("m.day").alias("day")).agg(F.sum("m.d").alias("d"))
    grid = delta.select(*group).distinct().crossJoin(F.broadcast(days)) if group else days
    filled = grid.join(delta, [*group, "day"], "left")
    return filled.select(*group, "day", W.running_sum(F.coalesce("d", F.lit(0)), list(group), "day").alias("n"))


def holder_count(change: DataFrame, start: str, as_of: str, min_balance: float = 0, by: Sequence[str] = ("token",)) -> DataFrame:
    """Distinct holders above ``min_balance`` per day."""
    open_ = balance_intervals(change, as_of).where(F.col("balance") > min_balance)
    days = spine(change.sparkSession, start, as_of)
    return active_count(open_, list(by), "day", "next_day", days).select(*by, "day", F.col("n").alias("holders"))


def multi_product_holders(change: DataFrame, start: str, as_of: str) -> DataFrame:
    """Per day: how many holders hold how many products."""
    open_ = balance_intervals(change, as_of).where(F.col("balance") > 0)
    stop = F.date_add(F.lit(as_of).cast("date"), 1)
    marks = F.explode(F.array(F.struct("day", F.lit(1).alias("d")), F.struct(F.col("next_day").alias("day"), F.lit(-1).alias("d"))))
    per = open_.select("holder", marks.alias("m")).groupBy("holder", F.col("m.day").alias("day")).agg(F.sum("m.d").alias("d"))
    held = per.select("holder", "day", W.running_sum("d", ["holder"], "day").alias("products"))
    held = step_intervals(held.where(F.col("day") < stop), ["holder"], "day", as_of).where("products > 0")
    days = spine(change.sparkSession, start, as_of)
    out = active_count(held, ["products"], "day", "next_day", days)
    return out.where("n > 0").select("day", "products", F.col("n").alias("holders"))


def exclude_contracts(df: DataFrame, labels: DataFrame, extra: DataFrame | None = None, key: str = "holder") -> DataFrame:
    """Drop addresses labelled as contracts or listed explicitly."""
    bad = labels.where(F.col("type") == "contract").select(F.col("address").alias(key))
    if extra is not None:
        bad = stack(bad, extra.select(F.col("address").alias(key)))
    return df.join(bad.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def flag_bots(moves: DataFrame, keys: Sequence[str] = ("token", "holder"), eps: float = 1e-14, min_moves: int = 2) -> DataFrame:
    """Holders with a day of at least ``min_moves`` moves that net to nothing or less."""
    per = moves.groupBy(*keys, "day").agg(F.sum("amount").alias("net"), F.count(F.lit(1)).alias("n"))
    return per.where((dbl("net") <= eps) & (F.col("n") >= min_moves)).select(*keys).distinct()


def holder_stats(change: DataFrame, min_balance: float = 1) -> DataFrame:
    """Per token: holders ever, holders above the floor, their mean, median and total."""
    last = balance_latest(change)
    big = F.col("balance") >= min_balance
    stats = last.groupBy("token").agg(
        F.count(F.lit(1)).alias("ever_held"),
        F.count(F.when(big, F.lit(1))).alias("holders_now"),
        (F.sum(F.when(big, F.col("balance"))).cast("double") / F.count(F.when(big, F.lit(1)))).alias("avg_balance"),
        F.sum(F.when(big, F.col("balance"))).alias("total_balance"),
    )
    med = exact_quantile(last.where(big), ["token"], "balance", 0.5, "median_balance")
    return stats.join(med, "token", "left")


def threshold_change(on_change: DataFrame, threshold: float) -> DataFrame:
    """Holders that reached the threshold: balance then and now, with group totals."""
    reached = F.when(F.col("balance") >= threshold, F.col("day"))
    per = (
        on_change.groupBy(*HOLDER)
        .agg(
            F.min_by(F.struct("day", "balance"), reached).alias("a"),
            F.max_by(F.struct("day", "balance"), "day").alias("z"),
            F.min(reached).alias("hit"),
        )
        .where(F.col("hit").isNotNull())
        .select(
            *HOLDER,
            F.col("a.day").alias("start_date"), F.col("a.balance").alias("start_balance"),
            F.col("z.day").alias("end_date"), F.col("z.balance").alias("end_balance"),
        )
    )
    totals = per.agg(
        F.count(F.lit(1)).alias("ever_reached"),
        F.count(F.when(F.col("end_balance") >= threshold, 1)).alias("still_there"),
        F.count(F.when(F.col("end_balance") > F.col("start_balance"), 1)).alias("adding"),
    )
    return scalar_join(per, totals)


def cross_holdings(change: DataFrame, focal: str, threshold: float, tokens: Sequence[str], labels: DataFrame) -> DataFrame:
    """Rounded balance of every listed token for each holder above the focal threshold, with labels."""
    last = balance_latest(change).where(F.col("token").isin(*tokens))
    # one aggregation gives the matrix row; the focal condition is a column of it
    wide = last.groupBy("holder").pivot("token", list(tokens)).agg(F.sum("balance")).where(F.col(focal) >= threshold)
    names = label_list(labels.join(wide.select(F.col("holder").alias("address")), "address", "left_semi"), "address", "name")
    out = wide.join(names.withColumnRenamed("address", "holder"), "holder", "left")
    return out.select("holder", *[F.coalesce(to_int(t), F.lit(0)).alias(t) for t in tokens], "labels")


def holdings_long(matrix: DataFrame, tokens: Sequence[str]) -> DataFrame:
    return matrix.unpivot(["holder"], list(tokens), "token", "amount")


def holding_stats(long: DataFrame, grouped: Sequence[str], group_name: str, skip: Sequence[str] = ()) -> DataFrame:
    """Per-token holder statistics; tokens in ``grouped`` are added up per holder into one class."""
    held = long.where(F.col("amount") > 0)
    single = held.where(~F.col("token").isin(*grouped, *skip)).select("token", "holder", "amount")
    classed = (
        held.where(F.col("token").isin(*grouped)).groupBy("holder").agg(F.sum("amount").alias("amount"))
        .select(F.lit(group_name).alias("token"), "holder", "amount")
    )
    rows = stack(single, classed)
    stats = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("holder_number"),
        F.sum("amount").alias("total_balance"),
        to_int(F.sum("amount").cast("double") / F.count(F.lit(1))).alias("avg_balance"),
        F.max("amount").alias("max_balance"),
        F.min("amount").alias("min_balance"),
    )
    med = exact_quantile(rows, ["token"], "amount", 0.5, "m").select("token", to_int("m").alias("median_balance"))
    everyone = long.agg(F.countDistinct("holder").alias("threshold_holders"))
    return scalar_join(stats.join(med, "token"), everyone)


def portfolio_value(long: DataFrame, prices: DataFrame) -> DataFrame:
    """USD value per holder from current prices (token, price)."""
    priced = long.join(prices, "token", "left")
    return priced.groupBy("holder").agg(to_int(F.sum(F.col("amount") * F.col("price"))).alias("total_value_usd"))


def circulating_supply(ledger: DataFrame, excluded: DataFrame, start: str, as_of: str, burn: Column | None = None) -> DataFrame:
    """Minted minus burned so far, and the same less what the excluded wallets hold."""
    spark = ledger.sparkSession
    is_mint, is_burn = F.col("from_addr") == ZERO, (F.col("to_addr") == ZERO) if burn is None else burn
    moves = ledger.where(is_mint | is_burn).select("token", "day", F.when(is_mint, F.col("value")).otherwise(-F.col("value")).alias("d"))
    daily = moves.groupBy("token", "day").agg(F.sum("d").alias("d"))
    grid = daily.select("token").distinct().crossJoin(F.broadcast(spine(spark, start, as_of)))
    total = grid.join(daily, ["token", "day"], "left").select(
        "token", "day", W.running_sum("d", ["token"], "day").alias("total_supply")
    )
    kept = daily_change(signed_ledger(ledger)).join(excluded.select(F.col("address").alias("holder")).distinct(), "holder", "left_semi")
    # the wallets' balances are only needed as a sum per day: add the changes first, then run the total
    out = kept.groupBy("token", "day").agg(F.sum("change").alias("c"))
    held = grid.join(out, ["token", "day"], "left").select("token", "day", W.running_sum("c", ["token"], "day").alias("held"))
    return total.join(held, ["token", "day"]).select(
        "token", "day", "total_supply", (F.col("total_supply") - F.coalesce("held", F.lit(0))).alias("circulating_supply")
    )
