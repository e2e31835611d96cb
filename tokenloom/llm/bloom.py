"""Bit tables (Bloom filters) over the hashes of a frame, built in parallel.

A table has ``BITS_PER_ROW`` bits a row up to ``MAX_BITS``, so what is broadcast
never exceeds ``MAX_BITS`` / 8 bytes; it never misses a row. ``tested`` takes
more rows than that in rounds of hash ranges, each with a table of its own, so
the share of rows that a table lets through does not grow. Tasks send the positions they hit, one message per segment,
and each segment is merged by one task of fixed memory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import fresh, materialise, tidy

BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 30
SEGMENTS = 64
PROBES = 4


def probe_positions(digests: list[bytes], bits: int) -> np.ndarray:
    """rows x PROBES positions; the digest itself supplies the hash values."""
    if not digests:
        return np.zeros((0, PROBES), np.uint64)
    h = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (h[:, :1] + np.arange(PROBES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def bit_segments(hashes: DataFrame, column: str, bits: int, hits: int) -> list[bytes]:
    """Bit segments whose set positions were hit by at least ``hits`` (1 or 2) rows."""
    width = bits // SEGMENTS

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            # a row counts once at a position even if two of its probes meet there
            p = np.sort(probe_positions(batch.column(0).to_pylist(), bits), axis=1)
            first = np.ones(p.shape, bool)
            first[:, 1:] = p[:, 1:] != p[:, :-1]
            found.append(p[first])
        at, times = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(at, np.arange(SEGMENTS + 1, dtype=np.uint64) * np.uint64(width))
        rows = [(s, (at[a:b] - np.uint64(s * width)).astype("<u4").tobytes(), np.packbits(times[a:b] > 1).tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["segment", "at", "twice"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], "<u4")
                twice = np.unpackbits(np.frombuffer(row["twice"], np.uint8), count=len(at))
                seen = counts.setdefault(row["segment"], np.zeros(width, np.uint8))
                seen[at] = np.minimum(seen[at] + 1 + twice, 2)
        for segment, seen in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(np.packbits(seen >= hits).tobytes(), 1)], pa.binary())], ["segment", "bits"])

    sent = hashes.select(column).mapInArrow(tidy(scatter), "segment int, at binary, twice binary")
    parts = sent.repartition(SEGMENTS, "segment").mapInArrow(tidy(gather), "segment int, bits binary").collect()
    out = [zlib.compress(bytes(width // 8), 1)] * SEGMENTS
    for row in parts:
        out[row["segment"]] = bytes(row["bits"])
    return out


def filter_bits(rows: int) -> int:
    return max(MIN_BITS, min(MAX_BITS, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def rounds_for(rows: int) -> int:
    """Hash ranges of which each has a table of its own."""
    return max(1, -(-rows * BITS_PER_ROW // MAX_BITS))


def tested(df: DataFrame, column: str, name: str, hits: int = 1) -> DataFrame:
    """``df`` with a column that is true where at least ``hits`` rows may have the row's digest."""
    rows = df.count()
    rounds = rounds_for(rows)
    if rounds == 1:
        return df.withColumn(name, bloom(df, column, hits, rows)(column))
    (part,) = fresh(df, "hash_range")
    path = scratch_path(df.sparkSession, "hash-ranges")
    df.withColumn(part, F.pmod(F.xxhash64(column), F.lit(rounds)).cast("int")).write.partitionBy(part).option("compression", "zstd").parquet(path)
    spread, out = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])).parquet(path), None
    for r in range(rounds):
        own = spread.where(F.col(part) == r).drop(part)
        # written before the next range's table is broadcast
        done = materialise(own.withColumn(name, bloom(own, column, hits)(column)), "range-tested")
        out = done if out is None else out.unionByName(done)
    return out


def membership(df: DataFrame, column: str, hits: int = 1, rows: int | None = None) -> Callable[[list[bytes]], np.ndarray]:
    """Test for use inside tasks: true for every digest that at least ``hits`` rows of ``df`` have."""
    bits, name = filter_bits(df.count() if rows is None else rows), uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(bit_segments(df, column, bits, hits))

    def maybe(digests: list[bytes]) -> np.ndarray:
        table = _table(name, shared.value)
        p = probe_positions(digests, bits)
        hit = table[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1
        return hit.all(axis=1)

    return maybe


def bloom(df: DataFrame, column: str, hits: int = 1, rows: int | None = None) -> Callable[[str], Column]:
    """``membership`` as a condition on a digest column."""
    maybe = membership(df, column, hits, rows)

    @F.arrow_udf("boolean")
    def test(digest: pa.Array) -> pa.Array:
        return pa.array(maybe(digest.to_pylist()))

    return test


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, segments: list[bytes]) -> np.ndarray:
    """The unpacked filter; a worker holds one at a time."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = np.frombuffer(b"".join(map(zlib.decompress, segments)), np.uint8)
    return _TABLES[name]
