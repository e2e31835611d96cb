"""Writers: seed tables, materialised steps, history caches, result files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import stack


def write_seed(df: DataFrame, path: str) -> DataFrame:
    """Replace a constant table; running it again gives the same table."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a step once and go on from the stored rows.

    The path belongs on storage that all executors share.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_history(df: DataFrame, path: str, day: str, cut: str) -> None:
    """Store the days before ``cut``, by month, so that readers skip what they do not need.

    The rebalance hint gathers small months and splits large ones, so no month
    has to pass through one task.
    """
    past = df.where(F.col(day) < F.lit(cut).cast("date"))
    past.withColumn("month", F.date_format(day, "yyyy-MM")).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def cached_union(live: DataFrame, path: str, day: str, cut: str) -> DataFrame:
    """Stored history before ``cut`` and live rows from it on; the cut day is in one half only."""
    past = live.sparkSession.read.parquet(path).select(live.columns)
    return stack(past.where(F.col(day) < F.lit(cut).cast("date")), live.where(F.col(day) >= F.lit(cut).cast("date")))


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, table: str | None = None) -> DataFrame:
    """Store rows hashed by ``keys`` into buckets and sorted by them, as a table whose readers know it.

    Grouping, windows and joins on the keys (or on more columns) of that table,
    by any number of reports, need no shuffle. One file a bucket: use it for
    rows already added up per key and day, so a busy key is no large bucket.
    """
    table = table or f"bucketed_{uuid.uuid4().hex}"
    laid = df.repartition(buckets, *keys)
    laid.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
