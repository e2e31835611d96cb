"""Calendars, gap filling, last-known values, step functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.frames import stack

Keys = Sequence[str]


def spine(spark: SparkSession, start: str, end: str, step: str = "1 day", name: str = "day") -> DataFrame:
    """One row per calendar step, both ends included. Days and longer are dates."""
    kind = "timestamp" if step.split()[1].rstrip("s") in ("hour", "minute", "second") else "date"
    seq = F.sequence(F.lit(start).cast(kind), F.lit(end).cast(kind), F.expr(f"interval {step}"))
    return spark.range(1).select(F.explode(seq).alias(name))


def entity_spine(df: DataFrame, keys: Keys, day: str, as_of: str, name: str | None = None) -> DataFrame:
    """Days of each key from its first row to ``as_of``."""
    end = F.lit(as_of).cast("date")
    return (
        df.groupBy(*keys)
        .agg(F.min(day).alias("_first"))
        .where(F.col("_first") <= end)
        .select(*keys, F.explode(F.sequence("_first", end, F.expr("interval 1 day"))).alias(name or day))
    )


def densify(df: DataFrame, keys: Keys, day: str, values: Keys, as_of: str, fill: Any = 0) -> DataFrame:
    """Sum per (key, day) on every day from the key's first one, gaps filled."""
    daily = df.groupBy(*keys, day).agg(*[F.sum(v).alias(v) for v in values])
    grid = entity_spine(daily, keys, day, as_of)
    out = grid.join(daily, [*keys, day], "left")
    return out if fill is None else out.select(*keys, day, *[F.coalesce(F.col(v), F.lit(fill)).alias(v) for v in values])


def locf(df: DataFrame, part: Keys, order: Keys | str, cols: Keys) -> DataFrame:
    """Last observation carried forward on calendar-sized partitions."""
    return df.withColumns({c: W.last_known(c, part, order) for c in cols})


def fill_by_group(df: DataFrame, part: Keys, order: str, value: str, out: str) -> DataFrame:
    """Same values as :func:`locf`, by counting non-NULLs and taking each group's first."""
    grp = F.count(value).over(W.over(part, order).rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy(*part, "_grp").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_grp", grp).withColumn(out, F.first(value).over(w)).drop("_grp")


def step_intervals(df: DataFrame, part: Keys, day: str, as_of: str, end: str = "next_day") -> DataFrame:
    """Attach the day from which the row is no longer valid (exclusive); rows after ``as_of`` go."""
    stop = F.date_add(F.lit(as_of).cast("date"), 1)
    return df.where(F.col(day) < stop).withColumn(end, W.following(day, part, day, stop))


def expand_intervals(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """One row per day of the half-open interval [start, end); empty ones give no row."""
    days = F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr("interval 1 day"))
    rest = [c for c in df.columns if c not in (start, end, name)]
    return df.where(F.col(start) < F.col(end)).select(*rest, F.explode(days).alias(name))


def order_key(df: DataFrame, order: Keys) -> Column | None:
    """One fixed-width sort key for one or two order columns, or None.

    Two whole-number (or time) columns such as (block, index) are packed into
    one decimal of 38 digits where every value of their types fits, negative
    ones too: a big second column needs a first one that is small or a time.
    """
    if len(order) == 1:
        return F.col(order[0])
    kinds = dict(df.dtypes)
    if len(order) != 2 or any(kinds[c] not in ("int", "bigint", "timestamp", "smallint") for c in order):
        return None
    small = kinds[order[1]] in ("int", "smallint")
    if not small and kinds[order[0]] == "bigint":
        return None

    def whole(c: str) -> Column:
        return (F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c)).cast("decimal(19,0)")

    span = F.lit(str(2**32 if small else 2**64)).cast("decimal(20,0)")
    return (whole(order[0]) * span).cast("decimal(38,0)") + whole(order[1])


def row_at(df: DataFrame, part: Keys, cols: Keys, order: Keys, last: bool = True) -> DataFrame:
    """Values of the last (or first) row per group by one or more order columns.

    With a fixed-width key each value is picked on its own, which keeps the
    aggregation buffers mutable and the aggregation a hash one; every column
    sees the same comparisons, so all come from the same row. Other keys are
    compared as a struct.
    """
    pick = F.max_by if last else F.min_by
    key = order_key(df, order)
    if key is not None:
        keyed = df.withColumn("_key", key)
        return keyed.groupBy(*part).agg(*[pick(c, "_key").alias(c) for c in cols])
    picked = df.groupBy(*part).agg(pick(F.struct(*cols), F.struct(*order)).alias("_r"))
    return picked.select(*part, *[F.col(f"_r.{c}").alias(c) for c in cols])


def closing(df: DataFrame, part: Keys, cols: Keys, order: Keys) -> DataFrame:
    """Values of the last row per group. Partial aggregation, no sort of the rows."""
    return row_at(df, part, cols, order)


def explode_ticks(df: DataFrame, lo: str, hi: str, step: int, name: str = "tick") -> DataFrame:
    """One row per tick of [lo, hi)."""
    rest = [c for c in df.columns if c != name]
    return df.where(F.col(lo) < F.col(hi)).select(*rest, F.explode(F.sequence(F.col(lo), F.col(hi) - 1, F.lit(step))).alias(name))


def stitch(primary: DataFrame, fallback: DataFrame, keys: Keys) -> DataFrame:
    """Primary rows, and fallback rows whose key the primary does not have."""
    rest = fallback.select(primary.columns).join(primary.select(*keys), list(keys), "left_anti")
    return stack(primary, rest)


def downsample(df: DataFrame, keys: Keys, ts: str, values: Mapping[str, Column], unit: str = "day") -> DataFrame:
    period = F.to_date(ts) if unit == "day" else F.date_trunc(unit, ts)
    return df.groupBy(*keys, period.alias(unit)).agg(*[c.alias(n) for n, c in values.items()])


def step_series(changes: DataFrame, part: Keys, day: str, value: str, order: Keys, as_of: str) -> DataFrame:
    """Daily value of a parameter that changes by events (last change of a day wins)."""
    daily = closing(changes, [*part, day], [value], order)
    return expand_intervals(step_intervals(daily, part, day, as_of), day, "next_day", day)


def trend(
    df: DataFrame,
    part: Keys,
    day: str,
    value: str,
    week: int = 7,
    month: int = 30,
    smooth: int = 7,
    smooth_first: bool = False,
    last_n: int | None = 7,
) -> DataFrame:
    """Change against one week and one month ago on a daily series.

    ``smooth_first`` averages the value before the change is taken; otherwise
    the change columns get a trailing average. Rows without both changes go.
    """
    base = df.withColumn("_v", W.moving_avg(value, part, day, smooth) if smooth_first else F.col(value).cast("double"))
    lagged = base.withColumns({"last_week": W.previous("_v", part, day, week), "last_month": W.previous("_v", part, day, month)})

    def change(prev: str) -> Column:
        return (F.col("_v") - F.col(prev)) / F.nullif(F.col(prev), F.lit(0.0))

    out = lagged.withColumns({"wow": change("last_week"), "mom": change("last_month")})
    out = out.withColumns({"wow_ma": W.moving_avg("wow", part, day, smooth), "mom_ma": W.moving_avg("mom", part, day, smooth)})
    out = out.where(F.col("wow").isNotNull() & F.col("mom").isNotNull()).drop("_v")
    if last_n is None:
        return out
    if not part:
        return out.orderBy(F.col(day).desc()).limit(last_n)
    recent = F.row_number().over(W.over(part, day, desc=True))
    return out.withColumn("_rn", recent).where(F.col("_rn") <= last_n).drop("_rn")
