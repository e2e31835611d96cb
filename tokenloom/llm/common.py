"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts lineage, survives lost executors, fixes whatever a task numbered, and
    gives the optimiser a measured size, so a join broadcasts the rows only if
    they are below Spark's own threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about ``BATCH_BYTES`` from here on, unless the session names a size itself.

    A batch is held several times over (Arrow buffers of the executor, the
    worker's copy, its Python objects), for every task and Python step at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def release_memory() -> None:
    """Give back to the system what Arrow and the C library hold without need."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def tidy(step: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back when a task ends.

    Python workers live on, idle, beside those of the next stages.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        release_memory()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive [from, to) ranges whose sizes add up to ``limit`` or just over."""
    start = end = total = 0
    for size in sizes:
        end += 1
        total += size
        if total >= limit:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end


def in_steps(batches: Iterable[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes of text, so that a worker holds little at a time."""
    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column(text)).fill_null(0).to_pylist(), limit):
            yield batch.slice(a, b - a)


def take_ranges(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The ranges [start, start + len) of ``flat``, one after the other."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


def bounds(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)))


def list_array(flat: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds(lens), pa.int32()), pa.array(flat, kind))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and length of each list; a null list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(column.flatten()), lens


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, rows) of input sorted by ``key``; one run is held at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


_ZSTD = pa.Codec("zstd", compression_level=9)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def varint(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**35 in seven-bit groups, low group first."""
    v = values.astype(np.uint64)
    n = 1 + sum((v >= np.uint64(1 << s)).astype(np.int64) for s in (7, 14, 21, 28))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for i in range(5):
        use = n > i
        part = (v[use] >> np.uint64(7 * i)) & np.uint64(127)
        out[at[use] + i] = part | ((n[use] > i + 1).astype(np.uint64) << np.uint64(7))
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for i in range(5):
        use = first + i <= last
        out[use] |= (raw[first[use] + i].astype(np.int64) & 127) << (7 * i)
    return out
