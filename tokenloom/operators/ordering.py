"""Global order statistics without one big sorted partition.

``ordered_scan`` range-partitions rows by a total order, sums each range,
and adds the totals of the ranges before it. No task sees more than one range,
whatever the ties or the size of a group. ``exact_quantiles`` needs no such
order: a sketch tells where to look, counting does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl
from ..session import cut_lineage

Order = Sequence[tuple[str, bool]]  # (column, descending)


def _order_cols(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, desc in order]


def ordered_scan(
    df: DataFrame,
    order: Order,
    sums: Mapping[str, str] | None = None,
    position: str = "position",
    ranges: int | None = None,
    keep_range: bool = False,
    totals: Mapping[str, str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Add the 1-based global position and inclusive running sums.

    ``totals`` names the grand total of a running sum, ``count`` that of the
    rows; both come from the ranges' sums, without another scan.

    ``order`` must end in a unique column: then no range can be dominated by
    ties. The range number is written by a checkpoint, so a task that runs
    again after an executor loss cannot change which rows share a range.
    """
    sums = dict(sums or {})
    cols = _order_cols(order)
    # without a stated number the runtime merges small neighbouring ranges, which keeps their order
    spread = df.repartitionByRange(ranges, *cols) if ranges else df.repartitionByRange(*cols)
    ranged = cut_lineage(spread.withColumn("_range", F.spark_partition_id()))
    per_range = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{out}") for out, c in sums.items()]
    )
    # one row per range, at most spark.sql.shuffle.partitions: this window and broadcast are bounded
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = {name: F.sum(f"_s_{out}").over(everything) for name, out in (totals or {}).items()}
    if count:
        whole[count] = F.sum("_n").over(everything)
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.sum(f"_s_{out}").over(before).alias(f"_o_{out}") for out in sums],
        *[c.alias(name) for name, c in whole.items()],
    )
    local = Window.partitionBy("_range").orderBy(*cols)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = (
        ranged.withColumn("_pos", F.row_number().over(local))
        .withColumns({f"_l_{o}": F.sum(c).over(upto) for o, c in sums.items()})
        .join(F.broadcast(offsets), "_range")
    )
    extra = [
        F.when(F.col(f"_o_{o}").isNull(), F.col(f"_l_{o}"))
        .otherwise(F.coalesce(F.col(f"_l_{o}"), F.lit(0)) + F.col(f"_o_{o}"))
        .alias(o)
        for o in sums
    ]
    keep = [F.col(f"`{c}`") for c in df.columns] + ([F.col("_range")] if keep_range else [])
    return out.select(*keep, (F.col("_pos") + F.col("_n0")).cast("bigint").alias(position), *extra, *whole)


SMALL = 10_000  # groups up to this size need no bracket
ACCURACY = 10_000  # the sketch is at most 1/ACCURACY of a group off


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group by sketch and selection; ``wanted`` maps output names to probabilities.

    A first scan builds a mergeable quantile sketch per group, from which come
    two values that enclose each wanted position. A second scan counts the rows
    between the brackets and keeps only those inside, about a thousandth of a
    large group, so no shuffle carries a hot group whole and nothing is sorted
    by a global range. Positions are exact; a bracket that missed its position
    would be an error, never a wrong value.
    """
    names = sorted(wanted, key=lambda n: wanted[n])
    reach = 4 / ACCURACY  # error of the sketch and, in groups over SMALL, the two positions of an interpolation
    fractions = [min(1.0, max(0.0, wanted[n] + d)) for n in names for d in (-reach, reach)]
    # rounding the value to a double keeps the order, so brackets are doubles; values stay exact
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), dbl(value).alias("_d"))
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_min"), F.max("_d").alias("_max"), F.percentile_approx("_d", fractions, ACCURACY).alias("_q")
    )
    small = F.col("_n") <= SMALL
    low = [F.when(small, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias(f"_l{i}") for i in range(len(names))]
    high = [F.when(small, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias(f"_u{i}") for i in range(len(names))]
    facts = facts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", *low, *high)
    if keys:
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        marked = rows.join(facts, same)
    else:
        marked = rows.crossJoin(F.broadcast(facts))  # one row
    above = reduce(add, [F.when(F.col("_d") > F.col(f"_u{i}"), 1).otherwise(0) for i in range(len(names))])
    inside = reduce(or_, [(F.col("_d") >= F.col(f"_l{i}")) & (F.col("_d") <= F.col(f"_u{i}")) for i in range(len(names))])
    # rows between brackets become one counted row each, equal values inside one another
    counted = marked.groupBy(*keys, above.alias("_gap"), F.when(inside, F.col("_v")).alias("_in")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_gap", F.col("_in").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.sum("_c").over(upto))

    def at(position: Column) -> Column:
        holds = (position < F.col("_end")) & (position >= F.col("_end") - F.col("_c"))
        return F.max(F.when(holds, F.when(F.col("_in").isNull(), F.raise_error(F.lit("a quantile bracket missed its position"))).otherwise(dbl("_in"))))

    def interpolated(p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        part = F.max(h - F.floor(h))
        return at(F.floor(h)) * (F.lit(1.0) - part) + at(F.ceil(h)) * part

    return placed.groupBy(*keys).agg(*[interpolated(p).alias(n) for n, p in wanted.items()])


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, out: str = "quantile") -> DataFrame:
    """One quantile of :func:`exact_quantiles`."""
    return exact_quantiles(df, keys, value, {out: p})


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Median per group by the built-in aggregate.

    For groups whose size is bounded by the calendar (hours of a day, days of
    a month); use :func:`exact_quantile` for trades or balances.
    """
    return df.groupBy(*keys).agg(F.percentile(dbl(value), F.lit(0.5)).alias(out))


def grouped_scan(
    df: DataFrame, keys: Sequence[str], order: Order, sums: Mapping[str, str] | None = None, position: str = "position", ranges: int | None = None
) -> DataFrame:
    """:func:`ordered_scan` with positions and sums that start anew in each group.

    The group's start is taken off per (range, key) piece, so rows of a hot
    group stay spread over its ranges.
    """
    sums = dict(sums or {})
    scan = ordered_scan(df, [(k, False) for k in keys] + list(order), sums, position, ranges, keep_range=True)
    before = [(F.col(o) - F.coalesce(F.col(c), F.lit(0))).alias(f"_b_{o}") for o, c in sums.items()]
    start = F.min_by(F.struct((F.col(position) - 1).alias("_b_pos"), *before), position)
    pieces = scan.groupBy("_range", *keys).agg(start.alias("_s"))
    groups = pieces.groupBy(*keys).agg(F.min_by("_s", "_s._b_pos").alias("_g"))
    facts = pieces.select("_range", *keys).join(groups, list(keys))
    j = scan.join(facts, ["_range", *keys])
    fixed = {position: F.col(position) - F.col("_g._b_pos")} | {o: F.col(o) - F.col(f"_g._b_{o}") for o in sums}
    return j.withColumns(fixed).drop("_g", "_range")
