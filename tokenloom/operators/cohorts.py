"""Cohort and retention reports on exposure intervals.

A holder's exposure changes on few days. All curves are therefore built from
intervals [from, to) of constant exposure: +weight at the start, -weight at
the end, one running sum per output series. The holder x day grid
(:func:`user_base`) exists for users who want the rows; no curve needs it.

Movement columns: token, holder, day, ts, amount, kind, tx_hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import ZERO, band, dbl, month_label, safe_div
from .ledger import HOLDER, exclude_contracts, flag_bots, signed_ledger

Keys = Sequence[str]

# fixed values: lower edges of the exposure bands, high to low
BANDS = [(250, "250+"), (50, "50-249"), (10, "10-49")]
LOWEST = "<10"


def movements(ledger: DataFrame, lp_moves: Sequence[tuple[DataFrame, int, str]], labels: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """Transfers and liquidity moves as one signed list without contracts and the zero address.

    ``lp_moves`` lists (rows with token, day, ts, tx_hash, holder, amount; sign; kind).
    Tokens added to a pool come back as exposure, so such moves are neutral.
    """
    parts = [signed_ledger(ledger, ["ts", "tx_hash"]).withColumn("kind", F.lit("transfer"))]
    for df, sign, kind in lp_moves:
        parts.append(df.select("token", "day", "ts", "tx_hash", "holder", (F.col("amount") * F.lit(sign)).alias("amount"), F.lit(kind).alias("kind")))
    rows = stack(*[p.select("token", "holder", "day", "ts", "tx_hash", "amount", "kind") for p in parts])
    return exclude_contracts(rows.where(F.col("holder") != ZERO), labels, pools)


def without_bots(moves: DataFrame) -> DataFrame:
    return moves.join(flag_bots(moves, HOLDER), HOLDER, "left_anti")


def holder_days(moves: DataFrame) -> DataFrame:
    """One row per holder and active day: net change, moves, and the highest running amount inside the day.

    Rows inside a day are ordered per (holder, day), so even a holder with a
    large part of all moves is split over its days.
    """
    steps = moves.groupBy(*HOLDER, "day", "ts").agg(F.sum("amount").alias("a"), F.count(F.lit(1)).alias("n"))
    inside = steps.withColumn("_p", W.running_sum("a", [*HOLDER, "day"], "ts"))
    per = inside.groupBy(*HOLDER, "day").agg(F.sum("a").alias("change"), F.sum("n").alias("moves"), F.max("_p").alias("_high"))
    before = F.coalesce(W.running_sum("change", HOLDER, "day") - F.col("change"), F.lit(0))
    return per.withColumns({"running": W.running_sum("change", HOLDER, "day"), "high": before + F.col("_high")}).drop("_high")


def _tagged(days: DataFrame, drop_bots: bool, bands=BANDS, lowest: str = LOWEST) -> DataFrame:
    """Holder days with cohort columns, by windows on the holder partition the running sums already use."""
    w = Window.partitionBy(*HOLDER)
    bot = F.max(F.when((dbl("change") <= 1e-14) & (F.col("moves") >= 2), 1).otherwise(0)).over(w)
    rows = days.withColumns({"_bot": bot, "start_dt": F.min("day").over(w), "_peak": F.max("high").over(w)})
    if drop_bots:
        rows = rows.where("_bot = 0")
    return rows.withColumns({"cohort": month_label("start_dt"), "exposure": band("_peak", bands, lowest)}).drop("_bot", "_peak")


def cohorts(moves: DataFrame, drop_bots: bool = False, bands=BANDS, lowest: str = LOWEST) -> DataFrame:
    """First day, month label and exposure band (by the highest running amount) of each holder."""
    tagged = _tagged(holder_days(moves), drop_bots, bands, lowest)
    return tagged.where(F.col("day") == F.col("start_dt")).select(*HOLDER, "start_dt", "cohort", "exposure")


def exposure_intervals(moves: DataFrame, as_of: str, frac: float | None = 0.75, drop_bots: bool = True, exclude_current: bool = False) -> DataFrame:
    """Intervals of constant exposure with cohort columns, cut at the cohort's mature days.

    ``lo`` / ``hi`` are 1-based day numbers since the holder's first day (hi is
    exclusive), ``day`` / ``until`` the calendar days. ``change`` is the amount
    moved on the first day of the interval. ``frac`` keeps day numbers up to
    the rounded share of the oldest holder's day number.
    """
    end = F.date_add(F.lit(as_of).cast("date"), 1)
    days = holder_days(moves.where(F.col("day") < end))
    rows = _tagged(days, drop_bots).withColumn("until", W.following("day", HOLDER, "day", end))
    if exclude_current:
        rows = rows.where(F.col("cohort") != month_label(F.lit(as_of).cast("date")))
    lo, hi = F.datediff("day", "start_dt") + 1, F.datediff("until", "start_dt") + 1
    if frac is None:
        out = rows.withColumns({"lo": lo, "hi": hi})
    else:
        oldest = rows.groupBy("token", "cohort").agg(F.min("start_dt").alias("_s"))  # tokens x months
        keep = F.round(F.datediff(end, F.col("_s")) * F.lit(float(frac)), 0).cast("int")
        limit = oldest.select("token", "cohort", keep.alias("include_days"))
        out = (
            rows.join(limit, ["token", "cohort"]).withColumns({"lo": lo, "hi": F.least(hi, F.col("include_days") + 1)})
            .where(F.col("lo") < F.col("hi")).withColumn("until", F.date_add("start_dt", F.col("hi") - 1))
        )
    return out.select(*HOLDER, "cohort", "exposure", "start_dt", "day", "until", "lo", "hi", "change", "running")


def level(iv: DataFrame, group: Keys, start: str, end: str, measures: dict[str, Column], axis: str) -> DataFrame:
    """Sum of each measure over the intervals open at every step where anything changes or is open.

    Steps are expanded only between the marks of one series, so the output is
    series x axis, whatever the number of holders.
    """
    signs = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("s")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("s"))))
    rows = iv.select(*group, *[m.alias(f"_{n}") for n, m in measures.items()], signs.alias("m"))
    delta = rows.groupBy(*group, F.col("m.at").alias("at")).agg(
        *[F.sum(F.col(f"_{n}") * F.col("m.s")).alias(n) for n in measures], F.sum("m.s").alias("_open")
    )
    run = delta.select(*group, "at", *[W.running_sum(n, list(group), "at").alias(n) for n in [*measures, "_open"]])
    nxt = run.withColumn("_to", W.following("at", list(group), "at")).where(F.col("_to").isNotNull() & (F.col("_open") > 0))
    kind = dict(iv.dtypes)[start]
    steps = F.sequence(F.col("at"), F.date_sub("_to", 1), F.expr("interval 1 day")) if kind == "date" else F.sequence(F.col("at"), F.col("_to") - 1)
    return nxt.select(*group, F.explode(steps).alias(axis), *measures)


def user_base(moves: DataFrame, as_of: str, frac: float | None = 0.75, drop_bots: bool = True) -> DataFrame:
    """One row per holder and day since the first: amount, running amount, day number, retained flag."""
    iv = exposure_intervals(moves, as_of, frac, drop_bots)
    n = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))
    rows = iv.select(*HOLDER, "cohort", "exposure", "start_dt", "lo", "change", F.col("running").alias("running_amount"), n.alias("day"))
    return rows.select(
        *HOLDER, "cohort", "exposure", F.date_add("start_dt", F.col("day") - 1).alias("dt"), "day",
        F.when(F.col("day") == F.col("lo"), F.col("change")).otherwise(F.lit(0)).alias("amount"), "running_amount",
        F.when(F.col("running_amount") > 0, 1).otherwise(0).alias("retained"),
    )


def retention(iv: DataFrame, by: str = "cohort", threshold: float | None = None) -> DataFrame:
    """Share of holders still exposed per series and day number.

    With a ``threshold`` the share still at or above it (for example whales
    that are still whales).
    """
    kept = F.col("running") > 0 if threshold is None else F.col("running") >= threshold
    one = F.when(kept, 1).otherwise(0)
    lv = level(iv, ["token", by], "lo", "hi", {"kept": one, "holders": F.lit(1)}, "day")
    return lv.select("token", by, "day", safe_div("kept", "holders").alias("retention"))


def retained_week(iv: DataFrame, preceding: int = 7, by: str = "cohort") -> DataFrame:
    """Share of holders exposed on the day or one of the ``preceding`` days before."""
    pos = iv.where("running > 0").select("token", "holder", by, "lo", "hi")
    last = iv.groupBy("token", "holder").agg(F.max("hi").alias("_max"))
    w = W.over(["token", "holder"], "lo")
    # lengthen each positive interval, but not into the next one or past the holder's last day
    reach = F.least(F.col("hi") + preceding, F.coalesce(F.lead("lo").over(w), F.lit(2**30)))
    ext = pos.withColumn("hi", reach).join(last, ["token", "holder"]).withColumn("hi", F.least("hi", "_max"))
    marked = stack(
        ext.select("token", by, "lo", "hi", F.lit(1).alias("kept"), F.lit(0).alias("holders")),
        iv.select("token", by, "lo", "hi", F.lit(0).alias("kept"), F.lit(1).alias("holders")),
    )
    lv = level(marked, ["token", by], "lo", "hi", {"kept": F.col("kept"), "holders": F.col("holders")}, "day")
    return lv.select("token", by, "day", safe_div("kept", "holders").alias("retention"))


def net_unit_retention(iv: DataFrame) -> DataFrame:
    """Units held by day number over the units of day one."""
    moved = iv.groupBy("token", F.col("lo").alias("day")).agg(F.sum("change").alias("amount"))
    last = iv.groupBy("token").agg((F.max("hi") - 1).alias("_n"))
    grid = last.select("token", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("day"))
    g = grid.join(moved, ["token", "day"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)))
    run = W.running_sum("amount", ["token"], "day")
    first = F.first("amount").over(W.over(["token"], "day"))
    return g.select("token", "day", "amount", run.alias("running_amount"), safe_div(run, first).alias("net_retention"))


def holders_by(iv: DataFrame, by: str) -> DataFrame:
    """Exposed holders per series and calendar day."""
    lv = level(iv.where("running > 0"), ["token", by], "day", "until", {"addresses": F.lit(1)}, "dt")
    return lv.where("addresses > 0")


def aum_by(iv: DataFrame, price: DataFrame, by: str) -> DataFrame:
    """Units and dollars of exposed holders per series and calendar day."""
    lv = level(iv.where("running > 0"), ["token", by], "day", "until", {"units": F.col("running")}, "dt")
    p = price.select(F.col("symbol").alias("token"), F.col("day").alias("dt"), dbl("price").alias("price"))
    return lv.join(p, ["token", "dt"], "left").select("token", by, "dt", "units", (dbl("units") * F.col("price")).alias("aum"))


def holders_growth(iv: DataFrame) -> DataFrame:
    """Holders and first day per band and cohort."""
    per = iv.groupBy(*HOLDER, "exposure", "cohort").agg(F.min("day").alias("d"))
    return per.groupBy("token", "exposure", "cohort").agg(F.min("d").alias("min_dt"), F.count(F.lit(1)).alias("addresses"))


def repeat_buyers(iv: DataFrame, cap: int = 5) -> DataFrame:
    """Per day: how many holders have bought on 1, 2, ... or ``cap``+ days."""
    buys = F.when((F.col("lo") == 1) | (F.col("change") > 0), 1).otherwise(0)
    b = iv.withColumn("n", W.running_sum(buys, HOLDER, "day"))
    text = F.when(F.col("n") < cap, F.col("n").cast("string")).otherwise(F.lit(f"{cap}+"))
    lv = level(b.withColumn("buys", text), ["token", "buys"], "day", "until", {"holders": F.lit(1)}, "dt")
    return lv.where("holders > 0")


def band_share(iv: DataFrame) -> DataFrame:
    """Holders and units per band and calendar day with their share of the day."""
    lv = level(iv, ["token", "exposure"], "day", "until", {"addresses": F.lit(1), "units": F.col("running")}, "dt").where("addresses > 0")
    return lv.withColumns({"address_share": W.share("addresses", ["token", "dt"]), "unit_share": W.share("units", ["token", "dt"])})


def holding_times(daily: DataFrame, as_of: str, width: int = 30, bands: int = 5) -> DataFrame:
    """Holders by time from first position to exit, in bands of ``width`` days.

    ``daily`` has the net change per holder and active day up to ``as_of``. Who
    has nothing left (a balance of zero or less) went out on the last day the
    balance changed, or at once if it never did; others hold until ``as_of``.
    The last balance is the sum of the changes, so no running sum is needed.
    Bands are closed below and open above, the last one is open.
    """
    moved = F.max(F.when(F.col("change") != 0, F.col("day")))
    per = daily.groupBy("holder").agg(F.min("day").alias("a"), F.coalesce(moved, F.min("day")).alias("z"), F.sum("change").alias("left"))
    kept = F.datediff(F.when(F.col("left") > 0, F.lit(as_of).cast("date")).otherwise(F.col("z")), F.col("a"))
    seq = F.least(F.floor(kept / F.lit(width)) + 1, F.lit(bands + 1))
    label = F.when(F.col("seq") > bands, F.lit(f"{bands}+ months")).otherwise(
        F.concat((F.col("seq") - 1).cast("string"), F.lit("-"), F.col("seq").cast("string"), F.lit(" months"))
    )
    return per.select(seq.alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("users")).select("seq", label.alias("holding_time"), "users")


# fixed values: lower edges of the trade-count bands, high to low
TRADE_BANDS = [(100, "100+"), (50, "50-100"), (25, "25-50"), (10, "10-25"), (5, "5-10")]


def trade_frequency(venues: Sequence[DataFrame], key: str = "holder", bands=TRADE_BANDS) -> DataFrame:
    """Users per trade-count band over all venues, counted per venue before the union is shuffled."""
    per = stack(*[v.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for v in venues]).groupBy(key).agg(F.sum("n").alias("n"))
    return per.groupBy(band("n", bands, "0-5").alias("trades")).agg(F.count(F.lit(1)).alias("users"))


def pre_post_exposure(intervals: DataFrame, members: DataFrame, event_day: str, as_of: str) -> DataFrame:
    """Mean daily exposure of the members before and after an event.

    ``intervals`` holds (holder, day, next_day, balance); a day counts when any
    member is exposed.
    """
    mine = intervals.where("balance > 0").join(members.select(F.col("address").alias("holder")).distinct(), "holder", "left_semi")
    lv = level(mine.withColumn("_g", F.lit(1)), ["_g"], "day", "next_day", {"exposure": F.col("balance")}, "dt")
    period = F.when(F.col("dt") < F.lit(event_day).cast("date"), F.lit("pre")).otherwise(F.lit("post"))
    return lv.groupBy(period.alias("period")).agg((F.sum("exposure").cast("double") / F.count(F.lit(1))).alias("avg_daily_exposure"))


def new_holders(intervals: DataFrame, members: DataFrame, event_day: str, as_of: str) -> DataFrame:
    """Balance and number of members who held nothing before the event, per day from it on."""
    day = F.lit(event_day).cast("date")
    mine = intervals.join(members.select(F.col("address").alias("holder")).distinct(), "holder", "left_semi")
    before = mine.where((F.col("day") < day) & (F.col("balance") > 0)).select("holder").distinct()
    rows = mine.where((F.col("balance") > 0) & (F.col("next_day") > day)).join(before, "holder", "left_anti")
    rows = rows.withColumn("day", F.greatest("day", day)).withColumn("_g", F.lit(1))
    lv = level(rows, ["_g"], "day", "next_day", {"total_balance": F.col("balance"), "holders": F.lit(1)}, "dt")
    return lv.where("holders > 0").select(F.col("dt").alias("day"), "total_balance", "holders")
