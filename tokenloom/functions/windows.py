"""Window helpers. The frame and the partition are always stated.

Windows without partition keys are meant for series that were aggregated to
one row per calendar step first, so their size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import col

Cols = Sequence[str]


def over(part: Cols, order: Cols | str, desc: bool = False) -> WindowSpec:
    keys = [order] if isinstance(order, str) else list(order)
    cols = [F.col(k).desc() if desc else F.col(k).asc() for k in keys]
    return Window.partitionBy(*part).orderBy(*cols) if part else Window.orderBy(*cols)


def running_sum(value: Column | str, part: Cols, order: Cols | str) -> Column:
    """ROWS frame from the first row to the current one."""
    return F.sum(col(value)).over(over(part, order).rowsBetween(Window.unboundedPreceding, 0))


def running_sum_peers(value: Column | str, part: Cols, order: Cols | str) -> Column:
    """RANGE frame: rows with equal order keys are added together."""
    return F.sum(col(value)).over(over(part, order).rangeBetween(Window.unboundedPreceding, 0))


def moving_avg(value: Column | str, part: Cols, order: Cols | str, preceding: int, following: int = 0) -> Column:
    """Mean over ``preceding + 1 + following`` rows; NULLs are skipped.

    Sum and count are divided as doubles, so decimal input stays exact up to
    the one division.
    """
    w = over(part, order).rowsBetween(-preceding, following)
    return F.sum(col(value)).over(w).cast("double") / F.nullif(F.count(col(value)).over(w).cast("double"), F.lit(0.0))


def moving_sum(value: Column | str, part: Cols, order: Cols | str, preceding: int) -> Column:
    return F.sum(col(value)).over(over(part, order).rowsBetween(-preceding, 0))


def full_window(value: Column | str, part: Cols, order: Cols | str, n: int, how: str = "mean") -> Column:
    """Rolling sum or mean that is NULL until ``n`` values are present."""
    w = over(part, order).rowsBetween(-(n - 1), 0)
    total = F.sum(col(value)).over(w).cast("double")
    result = total / F.lit(float(n)) if how == "mean" else total
    return F.when(F.count(col(value)).over(w) == n, result)


def previous(value: Column | str, part: Cols, order: Cols | str, n: int = 1) -> Column:
    return F.lag(col(value), n).over(over(part, order))


def following(value: Column | str, part: Cols, order: Cols | str, default=None) -> Column:
    nxt = F.lead(col(value), 1).over(over(part, order))
    return nxt if default is None else F.coalesce(nxt, default if isinstance(default, Column) else F.lit(default))


def last_known(value: Column | str, part: Cols, order: Cols | str) -> Column:
    """Last non-NULL value up to the current row."""
    return F.last(col(value), ignorenulls=True).over(over(part, order).rowsBetween(Window.unboundedPreceding, 0))


def share(value: Column | str, part: Cols) -> Column:
    """Part of the partition total."""
    c = col(value).cast("double")
    return c / F.nullif(F.sum(col(value)).over(Window.partitionBy(*part)).cast("double"), F.lit(0.0))


def any_recent(flag: Column | str, part: Cols, order: Cols | str, preceding: int) -> Column:
    """1 where the flag was set in the row or one of the ``preceding`` rows before."""
    return F.max(col(flag)).over(over(part, order).rowsBetween(-preceding, 0))
