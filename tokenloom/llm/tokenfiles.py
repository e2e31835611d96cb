"""Token-ID / binary output (3): ORC files in ascending doc_id order.

Layout of a folder: ``data/`` has one ORC file a part, rows sorted by doc_id,
columns doc_id, part, part_start (ids before the document in its part),
n_tokens and ids. Integer columns use ORC's run-length encoding; every file has
row indexes and a Bloom filter on doc_id, so a reader takes stripes in parallel
and skips those that cannot hold a document. ``manifest/`` has one row a part:
its first and last doc_id, rows, tokens and the tokens of all parts before it.

Parts are doc_id ranges (a range shuffle of the texts), encoded after the
shuffle; the global start is a sum over parts, never over documents.

Defined cases: null text counts as empty (its only id is the end id); null
doc_ids come first; rows of one doc_id are ordered by text; an empty table
gives an empty folder that reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import as_bytes, bounds, in_steps, list_array, list_parts, partitions
from .wordcodec import codec, tokenizer_file, with_end

DATA_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"
MANIFEST_SCHEMA = "part int, first_doc bigint, last_doc bigint, rows bigint, tokens bigint, start bigint"
ORC_OPTIONS = {
    "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    spark, content = docs.sparkSession, tokenizer_file(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = codec(content), TaskContext.get().partitionId(), 0
        for batch in in_steps(batches, 1):
            ids, lens = with_end(*coder.encode(as_bytes(batch.column(1))), end_id)
            before = bounds(lens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(lens), part), pa.int32()), pa.array(start + before[:-1], pa.int64()), pa.array(lens, pa.int64()), list_array(ids, lens, pa.int32())],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(before[-1])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(encode, DATA_SCHEMA).write.options(**ORC_OPTIONS).orc(f"{path}/data")
    parts = spark.read.schema(DATA_SCHEMA).orc(f"{path}/data").groupBy("part").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. Given ids prune stripes by index and Bloom filter."""
    data = spark.read.schema(DATA_SCHEMA).orc(f"{path}/data")
    if doc_ids is not None:
        data = data.where(F.col("doc_id").isin([int(i) for i in doc_ids]))
    manifest = spark.read.schema(MANIFEST_SCHEMA).orc(f"{path}/manifest").select("part", F.col("start").alias("before"))
    return data.join(manifest, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    flat, lens = list_parts(ids)
    data, cuts = memoryview(flat.astype("<u4").tobytes()), (bounds(lens) * 4).tolist()
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
