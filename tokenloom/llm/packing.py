"""Packing (10): best-fit decreasing over all documents.

Documents are encoded and closed with an end id; a document longer than a
window is first cut into full windows, so every piece is at most ``SIZE`` ids.
Best fit depends on lengths only, and there are at most ``SIZE`` of them: one
aggregation gives the histogram of lengths, and the plan is made on classes
(pieces of equal length, windows of equal remaining capacity) instead of single
pieces. A segment tree indexed by remaining capacity finds the tightest open
window. A class of windows takes a class of pieces in one step, which is what
the piece-by-piece rule would do, so the plan has a size bounded by ``SIZE``,
whatever the corpus, and is the exact global result. Spark then numbers the
pieces of each length and looks their sequence and offset up in the plan.

Defined cases: null text counts as empty and gives one piece (the end id);
null and repeated doc_ids are packed like any other row; an empty table gives
no pieces. Sequences are padded to ``SIZE`` unless their length is a power of
two (``padded``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounds, in_steps, list_array, materialise, tidy
from .wordcodec import codec, release, tokenizer_file, with_end

SIZE = 4096
PIECE_SCHEMA = "doc_id bigint, start bigint, length int, doc_tokens bigint, part int, nth bigint, ids_crc32 bigint"


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing on classes.

    Returns steps (length, first piece, end piece, first sequence, pieces a
    sequence, offset) and fills (first sequence, end sequence, tokens), sorted.
    """
    tree = CapacityTree(size)
    open_: dict[int, list[tuple[int, int]]] = {}
    steps, made = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        open_.setdefault(capacity, []).append((first, n))
        tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, made, -(-(total - done) // (size // length))
                made += n
            else:
                first, n = open_[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            whole = min(n, (total - done) // each)
            if whole:
                steps.append((length, done, done + whole * each, first, each, size - capacity))
                put(capacity - each * length, first, whole)
                done += whole * each
            if whole < n:
                rest = total - done
                if rest:
                    steps.append((length, done, total, first + whole, rest, size - capacity))
                    put(capacity - rest * length, first + whole, 1)
                    done, whole = total, whole + 1
                if whole < n:
                    put(capacity, first + whole, n - whole)
    fills = sorted((first, first + n, size - capacity) for capacity, ranges in open_.items() for first, n in ranges)
    return np.array(sorted(steps), np.int64).reshape(-1, 6), np.array(fills, np.int64).reshape(-1, 3)


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, numbered per part and length; written once, with their ids if they are wanted."""
    content = tokenizer_file(tokenizer)
    schema = PIECE_SCHEMA + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = codec(content), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in in_steps(batches, 1):
            ids, lens = with_end(*coder.encode(as_bytes(batch.column(1))), end_id)
            pieces = -(-lens // size)
            doc = np.repeat(np.arange(len(lens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            length = np.minimum(lens[doc] - start, size)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = seen[ranked] + np.arange(len(doc)) - np.searchsorted(ranked, ranked)
            seen += np.bincount(length, minlength=size + 1)
            data, cuts = memoryview(ids.astype("<u4").tobytes()), (bounds(length) * 4).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            columns = [
                batch.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(lens[doc], pa.int64()),
                pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth, pa.int64()), pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, list_array(ids, length, pa.int32())] if with_ids else columns, names)
        release()

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), schema), "pieces")


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id, offset, sequence_tokens and padded for every piece.

    Columns of ``pieces`` other than part, nth and length pass through.
    """
    counts = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    steps, fills = plan(histogram, size)
    shared = pieces.sparkSession.sparkContext.broadcast((steps, fills))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    @F.arrow_udf("struct<sequence_id bigint, offset bigint, sequence_tokens bigint, padded bigint>")
    def find(length: pa.Array, rank: pa.Array) -> pa.Array:
        steps, fills = shared.value
        n, r = np.asarray(length).astype(np.int64), np.asarray(rank)
        # both parts of the key are bounded, so they pack into one sortable number
        top = np.int64(1) << np.int64(48)
        at = np.searchsorted(steps[:, 0] * top + steps[:, 1], n * top + r, side="right") - 1
        s = steps[at]
        within = r - s[:, 1]
        sequence, offset = s[:, 3] + within // s[:, 4], s[:, 5] + within % s[:, 4] * n
        tokens = fills[np.searchsorted(fills[:, 0], sequence, side="right") - 1, 2]
        padded = np.where(tokens & (tokens - 1), size, tokens)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (sequence, offset, tokens, padded)], ["sequence_id", "offset", "sequence_tokens", "padded"])

    found = pieces.join(first, ["length", "part"]).withColumn("found", find("length", F.col("first") + F.col("nth")))
    return found.select(*[c for c in pieces.columns if c not in ("part", "nth")], "found.*")


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ... of every piece."""
    return place(cut_pieces(docs, tokenizer, with_ids=False)).withColumn("length", F.col("length").cast("long"))


def sequences(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """sequence_id, ids and doc_ids (one a piece, in order) of every packed sequence."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most SIZE ids a sequence
    placed = place(cut_pieces(docs, tokenizer)).groupBy("sequence_id").agg(rows.alias("rows"))
    return placed.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))
