"""Distinct holders as stored bitmaps.

Holders are numbered once; a set of holders is a list of 4 KB bitmaps, one per
32,768 numbers. Sets are built with map-side combine, so what crosses the network
is bitmaps, not rows, and a token that everybody holds is spread over its
buckets. Once stored per (token, day), any period and any union or intersection
of tokens is a combination of bitmaps; the ledger is not read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ordered_scan

Keys = Sequence[str]


def number_members(df: DataFrame, member: str, known: DataFrame | None = None) -> DataFrame:
    """(member, _id): a dense number from 0 for every distinct value.

    With ``known`` (member, _id) the numbers given before stay, and new members
    get the numbers that follow; sets stored earlier stay valid.
    """
    new = df.select(member).where(F.col(member).isNotNull()).distinct()
    if known is None:
        return ordered_scan(new, [(member, False)], position="_p").select(member, (F.col("_p") - 1).alias("_id"))
    first = known.agg((F.coalesce(F.max("_id"), F.lit(-1)) + 1).alias("_first"))  # one row
    fresh = ordered_scan(new.join(known, member, "left_anti"), [(member, False)], position="_p")
    fresh = fresh.crossJoin(F.broadcast(first)).select(member, (F.col("_p") - 1 + F.col("_first")).alias("_id"))
    return known.select(member, "_id").unionByName(fresh)


def bitmaps(df: DataFrame, keys: Keys, member: str, numbers: DataFrame) -> DataFrame:
    """keys, bucket, bits: the distinct members of every group."""
    # bitmap numbers start at 1, bit 1 of bucket 1
    rows = df.join(numbers, member).select(*keys, (F.col("_id") + 1).alias("_i"))
    cells = rows.select(*keys, F.bitmap_bucket_number("_i").alias("bucket"), F.bitmap_bit_position("_i").alias("_bit"))
    return cells.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def interval_bitmaps(intervals: DataFrame, keys: Keys, member: str, start: str, end: str, numbers: DataFrame, name: str = "day") -> DataFrame:
    """keys, day, bucket, bits from half-open [start, end) holding intervals.

    Days are made and set as bits in the same task; no holder-day row is shuffled.
    """
    rows = intervals.join(numbers, member).where(F.col(start) < F.col(end)).select(*keys, (F.col("_id") + 1).alias("_i"), start, end)
    days = F.explode(F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr("interval 1 day"))).alias(name)
    cells = rows.select(*keys, F.bitmap_bucket_number("_i").alias("bucket"), F.bitmap_bit_position("_i").alias("_bit"), days)
    return cells.groupBy(*keys, name, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def union_sets(sets: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Sets of coarser groups: a week of days, a class of tokens."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_members(sets: DataFrame, keys: Sequence[str | Column], out: str = "holders") -> DataFrame:
    """Exact number of distinct members of each group, over all rows of ``sets`` that share it."""
    one = union_sets(sets, keys)
    names = [c for c in one.columns if c not in ("bucket", "bits")]
    return one.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).alias(out))


def count_by_overlap(sets: DataFrame, keys: Keys, item: str, items: Sequence[str], count: str = "n", out: str = "holders") -> DataFrame:
    """How many members are in exactly n of the listed items' sets, per group.

    By inclusion and exclusion over the intersections of every subset of the
    items: 2**len(items) bitmaps a group and bucket, so for a stated, short list.
    """
    if len(items) > 12:
        raise ValueError("too many items for all their subsets")
    position = F.array_position(F.array(*[F.lit(x) for x in items]), F.col(item)) - 1
    listed = sets.where(F.col(item).isin(*items)).withColumn("_at", position.cast("int"))
    # subsets that hold the item, as bit masks
    masks = F.filter(F.sequence(F.lit(1), F.lit(2 ** len(items) - 1)), lambda m: F.call_function("getbit", m, F.col("_at")) == 1)
    cells = listed.select(*keys, "bucket", "bits", F.explode(masks).alias("_mask"))
    both = cells.groupBy(*keys, "bucket", "_mask").agg(F.bitmap_and_agg("bits").alias("_b"), F.count(F.lit(1)).alias("_present"))
    size = F.bit_count("_mask")
    # a subset counts where every item of it has a set in the bucket
    sums = both.where(F.col("_present") == size).groupBy(*keys, size.alias("_k")).agg(F.sum(F.bitmap_count("_b")).alias("_s"))
    terms = sums.withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))))
    table = F.create_map(*[F.lit(x) for k in range(1, len(items) + 1) for j in range(1, k + 1) for x in (k * 100 + j, (-1) ** (k - j) * comb(k, j))])
    weight = table[(F.col("_k") * 100 + F.col("_j")).cast("int")]
    return terms.groupBy(*keys, F.col("_j").cast("bigint").alias(count)).agg(F.sum(F.col("_s") * weight).alias(out)).where(F.col(out) > 0)
