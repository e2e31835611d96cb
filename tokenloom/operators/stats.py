"""Correlation, regression, bootstrap, rolling statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as W
from ..functions.scalar import dbl, safe_div
from ..session import cut_lineage
from .joins import scalar_join
from .ordering import ordered_scan


def _mean_ranks(pairs: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of each distinct value of counted pairs."""
    counted = pairs.groupBy(value).agg(F.sum("_n").alias("_m"))
    scan = ordered_scan(counted, [(value, False)], {"_c": "_m"}, position="_p")
    return scan.select(value, (dbl("_c") - (dbl("_m") - 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; one row.

    Equal pairs are counted first, ranks come from sorted distinct values.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))
    pairs = cut_lineage(pairs)  # read four times below
    j = pairs.join(_mean_ranks(pairs, x, "_rx"), x).join(_mean_ranks(pairs, y, "_ry"), y)
    n = pairs.agg(((F.sum("_n") + 1) / 2).alias("_mid"), F.sum("_n").alias("_all"))
    c = scalar_join(j, n)
    dx, dy, w = F.col("_rx") - F.col("_mid"), F.col("_ry") - F.col("_mid"), F.col("_n")
    s = c.agg(F.max("_all").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    return s.select("n", safe_div("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n latest rows of a series."""
    return df.orderBy(F.col(order).desc()).limit(n)


TAIL_STEPS = 2000  # Simpson's rule, an even number


def log_two_sided_p(t: Column, dof: Column, steps: int = TAIL_STEPS) -> Column:
    """Natural logarithm of the two-sided tail of Student's t, as an expression.

    With t = sqrt(dof) tan(a) the density becomes cos(a)**(dof - 1); the tail is
    its integral from a0 = atan(|t| / sqrt(dof)) to pi / 2 over that from 0. The
    value at a0 is taken out as a logarithm, and the integral runs as far as the
    rest matters, so very small tails keep their digits.
    """
    power = dof - F.lit(1.0)

    def integral(a: Column) -> Column:
        reach = F.least(F.lit(math.pi / 2) - a, F.lit(40.0) / (power * F.tan(a) + F.sqrt(dof)))
        h = reach / F.lit(float(steps))

        def term(i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * F.exp(power * (F.log(F.greatest(F.cos(a + i * h), F.lit(1e-300))) - F.log(F.cos(a))))

        total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + term(i))
        return total * h / F.lit(3.0)

    a0 = F.atan(F.abs(t) / F.sqrt(dof))
    return power * F.log(F.cos(a0)) + F.log(integral(a0)) - F.log(integral(F.lit(0.0)))


def linreg(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares line with correlation, standard error and p-value; one row."""
    cx, cy = dbl(x), dbl(y)
    s = df.where(cx.isNotNull() & cy.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"), F.corr(cx, cy).alias("r"),
        F.regr_sxx(cy, cx).alias("_sxx"), F.regr_syy(cy, cx).alias("_syy"),
    )
    se = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("r") * F.col("r")) * F.col("_syy") / F.col("_sxx") / F.nullif(F.col("n") - 2, F.lit(0)))
    s = s.withColumn("std_err", se).withColumn("_t", safe_div("slope", "std_err"))
    log_p = F.when(F.col("n") > 2, log_two_sided_p(F.col("_t"), dbl(F.col("n") - 2)))
    # a line without residuals leaves no tail
    p = F.when((F.col("std_err") == 0) & (F.col("slope") != 0), F.lit(0.0)).otherwise(F.exp(log_p))
    return s.select("n", "slope", "intercept", "r", p.alias("p_value"), "std_err", (log_p / F.lit(math.log(10))).alias("log10_p"))


# cumulative probabilities of the Poisson distribution with mean one, as shares of 2**32
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(13)]
MASK = 2**32 - 1


def _mixed(x: Column) -> Column:
    """Bijective mixing of 32-bit numbers held as bigint; the factors keep products below 2**63."""
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        x = x.bitwiseXOR(F.shiftright(x, shift)).cast("bigint") * F.lit(factor)
        x = x.bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 15))


def poisson_weight(key: Column, replicate: Column, seed: int) -> Column:
    """Poisson(1) weight of a row in a replicate: a function of both, whatever the split of the rows."""
    h = _mixed((key.cast("bigint") + F.lit(seed * 7919)).bitwiseAND(F.lit(MASK)))
    u = _mixed(h.bitwiseXOR((replicate.cast("bigint") * F.lit(2654435761)).bitwiseAND(F.lit(MASK))))
    return reduce(add, [F.when(u >= edge, 1.0).otherwise(0.0) for edge in POISSON])


def bootstrap_ci(df: DataFrame, key: str, value: str, n_boot: int = 10000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Sample deviation and its bootstrap interval; one row.

    Resampling by Poisson(1) weights that hash (row key, replicate, seed); the
    key is a whole number or a date. Each task makes its rows' replicates and
    adds them to three sums per replicate before anything is shuffled.
    """
    x = dbl(value)
    whole = F.unix_date(key) if isinstance(df.schema[key].dataType, T.DateType) else F.col(key)
    center = df.agg(F.avg(x).alias("_c"))  # sums of squares around the mean keep their digits
    rows = scalar_join(df.where(x.isNotNull()), center).select(whole.alias("_k"), (x - F.col("_c")).alias("_x"))
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k")  # a short series, too, is replicated by all cores
    each = rows.select("_x", "_k", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep"))
    w = each.select("rep", "_x", poisson_weight(F.col("_k"), F.col("rep"), seed).alias("_w"))
    tot = w.groupBy("rep").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("wx"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("wxx"))
    var = (F.col("wxx") - F.col("wx") * F.col("wx") / F.nullif(F.col("w"), F.lit(0.0))) / F.nullif(F.col("w") - 1, F.lit(0.0))
    tail = (1 - level) / 2
    ci = tot.select(F.sqrt(F.greatest(var, F.lit(0.0))).alias("_s")).agg(
        F.percentile("_s", F.lit(tail)).alias("ci_low"), F.percentile("_s", F.lit(1 - tail)).alias("ci_high")
    )
    return scalar_join(df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("std")), ci)


def rolling(df: DataFrame, part: Sequence[str], order: str, value: str, sizes: Sequence[int] = (7, 30)) -> DataFrame:
    """Rolling sums and means that are NULL until the window is full."""
    cols = {}
    for n in sizes:
        cols[f"sum_{n}"] = W.full_window(value, part, order, n, "sum")
        cols[f"mean_{n}"] = W.full_window(value, part, order, n, "mean")
    return df.withColumns(cols)


def overlay(df: DataFrame, key: str, series: Sequence[str]) -> DataFrame:
    """Series scaled to percent of their own peak, in long form."""
    peak = df.agg(*[F.max(dbl(s)).alias(f"_{s}") for s in series])
    scaled = scalar_join(df, peak).select(key, *[(F.lit(100.0) * dbl(s) / F.col(f"_{s}")).alias(s) for s in series])
    return scaled.unpivot([key], list(series), "series", "percent_of_peak")


def ratio_series(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two price series joined by time, and the first in units of the second."""
    j = a.select(key, dbl("price").alias("price")).join(b.select(key, dbl("price").alias("base_price")), key)
    return j.withColumn("ratio", safe_div("price", "base_price"))

