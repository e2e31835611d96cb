"""Market capture, market share, token screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack
from ..functions.scalar import dbl, safe_div
from .aggregates import earliest, pivot_fixed
from .joins import member_join, scalar_join


def market_capture(index_caps: DataFrame, caps: DataFrame, members: DataFrame, order: Sequence[str]) -> DataFrame:
    """Index value as percent of its members' summed market value per day.

    caps: (symbol, day, cap, order); the first observation of a day counts.
    index_caps: (day, cap, order); members: (symbol, in_day, out_day).
    """
    in_index = member_join(caps, members, "symbol", "day", "in_day", "out_day")
    first = earliest(in_index, ["symbol", "day"], ["cap"], order)
    coins = first.groupBy("day").agg(F.sum("cap").cast("double").alias("members_cap"))
    idx = earliest(index_caps, ["day"], ["cap"], order).select("day", dbl("cap").alias("index_cap"))
    j = idx.join(coins, "day", "left")
    return j.withColumn("market_capture", F.round(safe_div("index_cap", "members_cap") * 100, 3))


def market_share(caps: DataFrame, products: DataFrame) -> DataFrame:
    """Value per project and day with gaps of its products carried, and the percent of all projects.

    caps: (symbol, day, cap); products: (symbol, project). A product counts
    from its first day to the last day of any product.
    """
    daily = caps.groupBy("symbol", "day").agg((F.sum("cap").cast("double") / F.count("cap")).alias("cap"))
    span = daily.groupBy("symbol").agg(F.min("day").alias("_a"))
    end = daily.agg(F.max("day").alias("_z"))
    grid = scalar_join(span, end).select("symbol", F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))).alias("day"))
    full = grid.join(daily, ["symbol", "day"], "left").withColumn("cap", W.last_known("cap", ["symbol"], "day"))
    per = full.join(products.select("symbol", "project"), "symbol").groupBy("project", "day").agg(F.sum("cap").alias("cap"))
    return per.withColumn("percent", W.share("cap", ["day"]) * 100)


def market_share_wide(share: DataFrame, projects: Sequence[str]) -> DataFrame:
    return pivot_fixed(share, ["day"], "project", projects, F.first("percent"), 0.0)


def supply_ratio(px: DataFrame, supply: DataFrame) -> DataFrame:
    """Fully diluted value and circulating share per symbol and day; shares above one count as zero.

    px: (symbol, day, price, market_cap); supply: (symbol, total_supply).
    """
    j = px.join(supply, "symbol")
    diluted = dbl("price") * dbl("total_supply")
    part = safe_div("market_cap", diluted)
    return j.select("symbol", "day", "market_cap", diluted.alias("fully_diluted"), F.when(part > 1, F.lit(0.0)).otherwise(part).alias("percent_supply"))


def wide_filled(df: DataFrame, symbols: Sequence[str], value: str) -> DataFrame:
    """One column per symbol and one row per day, gaps filled from the row before."""
    wide = pivot_fixed(df, ["day"], "symbol", symbols, F.first(value))
    return wide.select("day", *[W.last_known(s, [], "day").alias(s) for s in symbols])


def screen(categories: Sequence[DataFrame], key: str = "id", order: str = "market_cap") -> DataFrame:
    """Tokens of several category lists, each once (earlier lists first), largest first."""
    tagged = stack(*[df.withColumn("_c", F.lit(i)) for i, df in enumerate(categories)])
    cols = [c for c in categories[0].columns if c != key]
    out = earliest(tagged, [key], cols, ["_c", order])
    return out.orderBy(F.col(order).desc(), key)
