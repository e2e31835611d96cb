"""Aggregations used by more than one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import stack
from ..functions.scalar import dbl
from .timeseries import closing, row_at

Keys = Sequence[str]


def latest(df: DataFrame, keys: Keys, cols: Keys, order: Keys) -> DataFrame:
    """Row with the greatest order key per group."""
    return closing(df, keys, cols, order)


def earliest(df: DataFrame, keys: Keys, cols: Keys, order: Keys) -> DataFrame:
    return row_at(df, keys, cols, order, last=False)


def one_per_key(df: DataFrame, keys: Keys) -> DataFrame:
    """One row per key where the source does not say which: the smallest row."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pivot_fixed(df: DataFrame, keys: Keys, name: str, values: Keys, measure: Column, fill=None) -> DataFrame:
    """Pivot to a stated list of columns, in one aggregation and no discovery scan."""
    out = df.groupBy(*keys).pivot(name, list(values)).agg(measure)
    return out if fill is None else out.na.fill(fill, list(values))


def unpivot(df: DataFrame, keys: Keys, values: Keys, name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def vwap(num: Column | str, den: Column | str) -> Column:
    """Ratio of sums."""
    return F.sum(num).cast("double") / F.nullif(F.sum(den).cast("double"), F.lit(0.0))


def sum_if(cond: Column, value: Column | str) -> Column:
    return F.sum(F.when(cond, F.col(value) if isinstance(value, str) else value))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def with_total(df: DataFrame, label_col: str, group: Keys, sums: Keys, label: str = "Total") -> DataFrame:
    """Detail rows and one total row per group."""
    total = df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label_col, F.lit(label))
    return stack(df.select(label_col, *group, *sums), total.select(label_col, *group, *sums))


def histogram_of_counts(df: DataFrame, group: Keys, inner: str, item: str, out: str = "n") -> DataFrame:
    """How many ``inner`` have how many distinct ``item``, per group."""
    per = df.select(*group, inner, item).distinct().groupBy(*group, inner).agg(F.count(F.lit(1)).alias(out))
    return per.groupBy(*group, out).agg(F.count(F.lit(1)).alias("members"))


def label_list(df: DataFrame, key: str, label: str, sep: str = "| ") -> DataFrame:
    """Distinct labels of a key, sorted, as one text."""
    d = df.select(key, label).distinct()
    return d.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(label)), sep).alias("labels"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sample deviation, min, max of a column."""
    return df.agg(
        F.count(value).alias("n"),
        (F.sum(value).cast("double") / F.count(value)).alias("mean"),
        F.stddev_samp(dbl(value)).alias("std"),
        F.min(dbl(value)).alias("min"),
        F.max(dbl(value)).alias("max"),
    )
