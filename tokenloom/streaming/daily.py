"""Daily roll-ups kept up to date from an append-only event folder.

Two forms. With a watermark, closed days are appended to a history folder by a
streaming query; readers take the history and add the open days from the raw
events, the streaming form of a frozen cache with a live tail. Without one,
every micro-batch adds its partial sums to a store that is kept from run to run;
an event of any age, also of a day long closed, is one more partial sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import stack


def event_stream(spark: SparkSession, folder: str, like: DataFrame, file_pattern: str = "*.parquet") -> DataFrame:
    """Stream of an append-only Parquet folder with the schema of a static read."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", file_pattern).parquet(folder)


def daily_sums(events: DataFrame, ts: str, keys: Sequence[str], value: str, lateness: str = "1 hour") -> DataFrame:
    """Sum and count per key and day; works on streams (with a watermark) and on tables."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, lateness)
    w = F.window(ts, "1 day")
    out = rows.groupBy(w.alias("w"), *keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("w.start").alias("day"), *keys, value, "n")


def append_closed_days(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and append the days the watermark has closed."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def with_open_days(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and the live days after its last one.

    Only events after the last closed day are read again when ``live`` comes
    from a scan that prunes by day.
    """
    last = history.agg(F.max("day").alias("_last"))
    tail = live.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("day") > F.col("_last"))).select(live.columns)
    return stack(history.select(live.columns), tail)


def _partial(batch: DataFrame, ts: str, keys: Sequence[str], value: str) -> DataFrame:
    return batch.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))


def merge_days(events: DataFrame, ts: str, keys: Sequence[str], value: str, path: str, checkpoint: str) -> None:
    """Add what is new in a stream to the stored sums per day and key.

    A micro-batch writes its sums to a folder named by its number, so a batch
    that runs again after a failure replaces itself and counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        _partial(batch, ts, keys, value).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    query = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged_days(spark: SparkSession, path: str, keys: Sequence[str], value: str) -> DataFrame:
    """Sums and counts per day and key over all batches taken in so far."""
    parts = spark.read.parquet(f"{path}/parts")
    return parts.groupBy("day", *keys).agg(F.sum(value).alias(value), F.sum("n").alias("n"))
