"""Joins that need more than an equality: validity ranges, as-of, either side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .timeseries import row_at

Keys = Sequence[str]
WIDE = 1000  # buckets a wide bucket holds


BIN_DAYS = 32


def _axis(df: DataFrame, c: str) -> Column:
    """Dates as days, times as seconds, numbers as they are."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return F.unix_seconds(F.col(c).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(c)


def interval_join(
    left: DataFrame, right: DataFrame, keys: Keys, left_range: tuple[str, str], right_range: tuple[str, str], width: int = BIN_DAYS, how: str = "inner", closed: bool = True
) -> DataFrame:
    """Pairs of equal keys whose ranges overlap, for two sides of any size.

    Ranges are cut into bins of ``width`` (days of dates, seconds of times), so
    the join is one of equality on (key, bin): the ranges of a hot key meet bin
    by bin, not all with all. A pair that shares several bins is kept in its
    first. Right ranges are cut to the span of the left side first; an open end
    costs no bins beyond it. The same column twice in ``left_range`` means
    points, which have one bin each and may be kept without a partner
    (``how="left"``). ``closed`` False excludes the ends. Right columns come
    back under their names with ``_r_`` in front; empty ranges and NULL ends
    meet nothing.
    """
    (lb, le), (rb, re) = left_range, right_range
    points = lb == le
    if how != "inner" and not points:
        raise ValueError("only points can be kept without a partner")

    def bin_of(c: Column) -> Column:
        return F.floor(c / width).cast("bigint")

    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(bin_of(first), bin_of(last)))

    span = left.agg(F.min(_axis(left, lb)).alias("_low"), F.max(_axis(left, le)).alias("_high"))  # one row
    cut = right.crossJoin(F.broadcast(span)).where(F.col(rb) <= F.col(re))
    cut = cut.withColumns({"_from": F.greatest(_axis(right, rb), "_low"), "_to": F.least(_axis(right, re), "_high")}).where("_from <= _to")
    cut = cut.withColumn("_bin", bins(F.col("_from"), F.col("_to")))
    r = cut.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns], "_from", F.col("_bin").alias("_r_bin"))
    if points:
        cells = left.withColumn("_bin", bin_of(_axis(left, lb)))
    else:
        cells = left.where(F.col(lb) <= F.col(le)).withColumn("_bin", bins(_axis(left, lb), _axis(left, le)))
    on = F.col("_bin") == F.col("_r_bin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if closed:
        on = on & (F.col(lb) <= F.col(f"_r_{re}")) & (F.col(f"_r_{rb}") <= F.col(le))
    else:  # a point meets the range that starts with it, two ranges must share more than an end
        on = on & (F.col(lb) < F.col(f"_r_{re}")) & (F.col(f"_r_{rb}") <= F.col(le) if points else F.col(f"_r_{rb}") < F.col(le))
    out = cells.join(r, on, how)
    if not points:
        out = out.where(F.col("_bin") == F.greatest(bin_of(_axis(left, lb)), bin_of(F.col("_from"))))
    return out.select(*left.columns, *[f"_r_{c}" for c in right.columns])


def scd_join(fact: DataFrame, dim: DataFrame, keys: Keys, day: str, begin: str, end: str, how: str = "left") -> DataFrame:
    """Dimension row whose [begin, end] range holds the fact's day."""
    rest = [c for c in dim.columns if c not in keys]
    out = interval_join(fact, dim, keys, (day, day), (begin, end), how=how)
    return out.select(*fact.columns, *[F.col(f"_r_{c}").alias(c) for c in rest])


def member_join(fact: DataFrame, members: DataFrame, key: str, day: str, start: str, stop: str) -> DataFrame:
    """Facts on days the key was a member; ``stop`` equal to ``start`` means still in."""
    end = F.when(F.col(stop) == F.col(start), F.lit("9999-12-31").cast("date")).otherwise(F.col(stop))
    m = members.select(F.col(key), F.col(start).alias("_s"), end.alias("_e"))
    return interval_join(fact, m, [key], (day, day), ("_s", "_e")).select(*fact.columns)


def either_side_join(
    trades: DataFrame, prices: DataFrame, trade_key: Keys, bucket: str, side_a: tuple[str, str], side_b: tuple[str, str]
) -> DataFrame:
    """Price a two-sided trade by whichever side has a price in its time bucket.

    An OR condition cannot be hashed, so each side is joined by equality and
    side a wins where both are priced. ``prices`` holds (bucket, symbol,
    price), one row per pair, so no trade is repeated; equal trade rows count
    once. Decimal amounts and prices stay decimal, so sums of the result do
    not depend on their order.
    """
    (sym_a, amt_a), (sym_b, amt_b) = side_a, side_b
    rows = trades.select(*trade_key, bucket, sym_a, amt_a, sym_b, amt_b).distinct()
    for sym, out in ((sym_a, "_pa"), (sym_b, "_pb")):
        rows = rows.join(prices.select(bucket, F.col("symbol").alias(sym), F.col("price").alias(out)), [bucket, sym], "left")
    own = F.col("_pa").isNotNull()

    def pick(a: str, b: str) -> Column:
        return F.when(own, F.col(a)).otherwise(F.col(b))

    priced = rows.where(own | F.col("_pb").isNotNull())
    out = priced.select(*trade_key, bucket, pick(sym_a, sym_b).alias("symbol"), pick(amt_a, amt_b).alias("amount"), pick("_pa", "_pb").alias("price"))
    return out.withColumn("usd_amount", F.col("amount") * F.col("price"))


def _wide(df: DataFrame) -> Column:
    """Non-decreasing wide bucket of ``_b``: many numbers or dates, a day of times, the first field of a struct."""
    kind = df.schema["_b"].dataType
    if isinstance(kind, T.StructType):
        return F.col("_b")[kind.names[0]]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date("_b")
    return F.floor((F.unix_date("_b") if isinstance(kind, T.DateType) else F.col("_b")) / WIDE)


def _carried(ends: DataFrame, keys: Keys, values: Keys, total: bool = False) -> DataFrame:
    """Per key and bucket ``_b``: the last values before the bucket, or the sums of those before it.

    Two levels: over wide buckets first, whose result then stands in front of
    the buckets inside, so no window holds all buckets of a hot key. The ends
    are written once and read by both levels.
    """
    ends = cut_lineage(ends)
    e = ends.withColumn("_w", _wide(ends))
    known = F.col("_b")

    def whole(v: str) -> Column:
        return F.sum(v) if total else F.max_by(v, F.when(F.col(v).isNotNull(), known))

    def before(part: Keys, order: Column) -> list[Column]:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [(F.sum(v).over(w) if total else F.last(v, ignorenulls=True).over(w)).alias(v) for v in values]

    far = e.groupBy(*keys, "_w").agg(*[whole(v).alias(v) for v in values]).select(*keys, "_w", *before(keys, F.col("_w")))
    start = far.withColumn("_b", F.lit(None).cast(ends.schema["_b"].dataType))
    near = e.unionByName(start).select(*keys, "_b", *before([*keys, "_w"], F.col("_b").asc_nulls_first()))
    return near.where(known.isNotNull())


def _in_front(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """The carried row of each bucket before its rows: ``_row`` 0 and 1."""
    return rows.withColumn("_row", F.lit(1)).unionByName(carry.withColumn("_row", F.lit(0)), allowMissingColumns=True)


def asof_last(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    order: Keys,
    cols: Keys,
    bucket: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Attach to each left row the last right values at or before it.

    ``bucket`` is a non-decreasing function of the order columns (a day, a
    block range). Work is split by (key, bucket); what a bucket needs from
    earlier ones is one carried row, so a hot key is cut by time.
    """
    vals = F.struct(*[F.col(c).alias(c) for c in cols])
    r = right.withColumn("_b", bucket)
    lft = left.withColumn("_b", bucket).withColumn("_tag", F.lit(1 if inclusive else 0)).withColumn("_left", F.lit(True))
    both = lft.unionByName(r.select(*keys, *order, "_b", vals.alias("_v"), F.lit(0 if inclusive else 1).alias("_tag"), F.lit(False).alias("_left")), allowMissingColumns=True)
    # every bucket of either side; left rows have no order value, so no end is taken from them
    kinds = {**dict(right.dtypes)}
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in dict.fromkeys([*order, *cols])]
    marks = r.select(*keys, "_b", *dict.fromkeys([*order, *cols]), F.lit(True).alias("_has")).unionByName(lft.select(*keys, "_b", *nothing, F.lit(None).cast("boolean").alias("_has")))
    ends = row_at(marks, [*keys, "_b"], [*cols, "_has"], order).select(*keys, "_b", F.when(F.col("_has"), vals).alias("_v"))
    carry = _carried(ends, keys, ["_v"])
    w = Window.partitionBy(*keys, "_b").orderBy("_row", *order, "_tag").rowsBetween(Window.unboundedPreceding, 0)
    found = _in_front(both, carry).withColumn("_got", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return found.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in cols])


def previous_row(df: DataFrame, keys: Keys, order: Keys, cols: Sequence[tuple[str, str]], bucket: Column) -> DataFrame:
    """Values of the row before, per key, with hot keys cut into time buckets.

    ``cols`` maps a column to the name of its lagged copy.
    """
    names = [c for c, _ in cols]
    b = df.withColumn("_b", bucket)
    ends = row_at(b, [*keys, "_b"], names, order).select(*keys, "_b", F.struct(*names).alias("_v"))
    carry = _carried(ends, keys, ["_v"]).select(*keys, "_b", *[F.col(f"_v.{c}").alias(f"_l_{c}") for c in names])
    rows = b.withColumns({f"_l_{c}": F.col(c) for c in names})
    w = Window.partitionBy(*keys, "_b").orderBy("_row", *order)
    out = _in_front(rows, carry).withColumns({n: F.lag(f"_l_{c}").over(w) for c, n in cols}).where("_row = 1")
    return out.select(*df.columns, *[n for _, n in cols])


def running_totals(df: DataFrame, keys: Keys, order: Keys, sums: Mapping[str, str], bucket: Column) -> DataFrame:
    """Running sums of event rows per key, cut into time buckets like :func:`previous_row`.

    ``sums`` maps the name of a running sum to its column; all are made in one pass.
    """
    b = df.withColumn("_b", bucket).withColumns({f"_s_{out}": F.col(c) for out, c in sums.items()})
    parts = [f"_s_{out}" for out in sums]
    carry = _carried(b.groupBy(*keys, "_b").agg(*[F.sum(p).alias(p) for p in parts]), keys, parts, total=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = _in_front(b, carry).withColumns({out: F.sum(f"_s_{out}").over(w) for out in sums}).where("_row = 1")
    return out.select(*[c for c in df.columns if c not in sums], *sums)


def running_total(df: DataFrame, keys: Keys, order: Keys, value: str, out: str, bucket: Column) -> DataFrame:
    """One sum of :func:`running_totals`."""
    return running_totals(df, keys, order, {out: value}, bucket)


def scalar_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    return df.crossJoin(F.broadcast(one_row))
