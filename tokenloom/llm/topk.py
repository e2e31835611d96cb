"""Exact top-k search (8): multi-resolution segment statistics.

Every vector is described at several resolutions by the mean and the standard
deviation of its segments. For two vectors the squared distance is at least
``sum(l * ((m1 - m2)**2 + (s1 - s2)**2))`` over the segments of length l. With
``<q, x> = (|q|**2 + |x|**2 - d**2) / 2`` that lower bound of the distance is
the upper bound ``sum(l * (m1 * m2 + s1 * s2))`` of the score, a short inner
product. Coarse bounds are computed for whole blocks, finer ones for the pairs
that survive, exact scores for the rest.

The stated queries are packed into blocks and broadcast in rounds of at most
``ROUND_BYTES``, each round's result written before the next; the rows are never
moved, each task keeps the best k of its own rows, and the lists of all tasks
are merged per query. A sample of about ``SEEDS`` rows gives each query a first threshold (a bound on what is skipped;
it never changes a result).

Scores are exact integers. Doubles carry them where |q| |x| is below 2**53,
64-bit integers below 2**63, and whole numbers of any size beyond; a score that
no long holds counts as the largest or smallest long. Bounds are widened by
what their own sums can be off by.

Defined cases: vectors that are null or hold null or non-finite components,
and rows without vec_id, take no part; only vectors of equal length meet; rows
that repeat a vec_id are candidates each, and no row meets a query of its own
vec_id; a query repeated in the table is answered once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_parts, materialise, runs

K = 20
SEGMENTS = (4, 16)
BLOCK, SEEDS = 1024, 1024
ROUND_BYTES = 64 << 20
FOUND = "query_id bigint, vec_id bigint, score bigint"
LONG = (1 << 63) - 1
EPS = float(np.finfo(np.float64).eps)


def cleaned(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and the components, packed; written once."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            flat, lens = list_parts(column.cast(pa.list_(pa.float64())))
            flat, ends = flat.astype(np.float64), np.cumsum(lens)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = (bad[ends] == bad[ends - lens]) & np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
            rows = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(lens[rows], pa.int32()), pa.array([flat[ends[i] - lens[i] : ends[i]].astype("<f8").tobytes() for i in rows], pa.binary())],
                ["vec_id", "dim", "v"],
            )

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return materialise(rows.mapInArrow(clean, "vec_id bigint, dim int, v binary"), "vectors")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row sqrt(l) * mean and sqrt(l) * deviation of every segment."""
    n, dim = x.shape
    cuts = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int)) if dim else np.array([0])
    if len(cuts) < 2:
        return np.zeros((n, 1))
    lens = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    mean = total / lens
    off = x - np.repeat(mean, lens, axis=1)
    return np.concatenate((mean * np.sqrt(lens), np.sqrt(np.add.reduceat(off * off, cuts[:-1], axis=1))), axis=1)


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each q, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], scores[keep]


class Rows:
    """Vectors of one length: floor(64 x) as doubles, norms, and segment statistics.

    ``wild`` rows have components that products of doubles cannot carry; they
    are compared as whole numbers only.
    """

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        self.ids, self.raw = ids, raw
        with np.errstate(over="ignore"):
            self.x = np.floor(64.0 * raw)
        self.wild = ~(np.abs(self.x) < 2.0**400).all(axis=1)
        self.x[self.wild] = 0
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.levels = [statistics(self.x, s) for s in SEGMENTS]
        self._whole: dict[int, list[int]] = {}

    def whole(self, i: int) -> list[int]:
        if i not in self._whole:
            self._whole[i] = [64 * int(v) if abs(v) >= 2.0**53 else math.floor(64.0 * v) for v in self.raw[i].tolist()]
        return self._whole[i]


def slack(dim: int, products: np.ndarray) -> np.ndarray:
    """What sums of doubles, of products of norms ``products``, can be off by."""
    return 16 * (dim + 4) * EPS * products


def lowered(v: np.ndarray) -> np.ndarray:
    """A double that is not above the whole number behind ``v``."""
    return v - np.abs(v) * 4 * EPS


def exact_scores(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the listed pairs; a score beyond a long is the nearest long."""
    size, wild = a.norm[i] * b.norm[j], a.wild[i] | b.wild[j]
    out = np.zeros(len(i), np.int64)
    doubles, longs = (size < 2.0**53) & ~wild, (size >= 2.0**53) & (size < 2.0**62) & ~wild
    if doubles.all():
        return np.rint(pair_products(a.x, b.x, i, j)).astype(np.int64)
    out[doubles] = np.rint(pair_products(a.x, b.x, i[doubles], j[doubles])).astype(np.int64)
    for at in np.array_split(np.flatnonzero(longs), max(1, int(longs.sum()) * a.x.shape[1] >> 20)):
        out[at] = np.einsum("ij,ij->i", a.x[i[at]].astype(np.int64), b.x[j[at]].astype(np.int64))
    for at in np.flatnonzero(~doubles & ~longs).tolist():
        score = sum(p * q for p, q in zip(a.whole(int(i[at])), b.whole(int(j[at]))))
        out[at] = max(-LONG, min(LONG, score))
    return out


class QueryBlock(Rows):
    """Queries of one length with what each has found so far."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, threshold: np.ndarray, k: int):
        super().__init__(ids, raw)
        # scores beyond the longs tie at their ends
        self.threshold, self.k = np.where(threshold <= -LONG, -np.inf, np.minimum(threshold, lowered(np.float64(LONG)))), k
        self.found = (np.zeros(0, np.int64),) * 3

    def offer(self, rows: Rows) -> None:
        floor, dim = self.threshold - 0.5, self.x.shape[1]  # scores are whole numbers
        wild = self.wild[:, None] | rows.wild
        first = self.levels[0] @ rows.levels[0].T + slack(dim, self.norm[:, None] * rows.norm)
        q, c = np.nonzero(((first >= floor[:, None]) | wild) & (self.ids[:, None] != rows.ids))
        for mine, other in zip(self.levels[1:], rows.levels[1:]):
            if not len(q):
                return
            keep = (pair_products(mine, other, q, c) + slack(dim, self.norm[q] * rows.norm[c]) >= floor[q]) | wild[q, c]
            q, c = q[keep], c[keep]
        if not len(q):
            return
        score = exact_scores(self, rows, q, c)
        keep = score >= self.threshold[q]
        q, c, score = q[keep], c[keep], score[keep]
        held = self.found
        self.found = best(np.concatenate((held[0], q)), np.concatenate((held[1], rows.ids[c])), np.concatenate((held[2], score)), self.k)
        last = np.flatnonzero(np.arange(len(self.found[0])) - np.searchsorted(self.found[0], self.found[0]) == self.k - 1)
        at, least = self.found[0][last], self.found[2][last]
        # all that is below the longs ties there
        self.threshold[at] = np.maximum(self.threshold[at], np.where(least <= -LONG, -np.inf, lowered(least.astype(np.float64))))


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """<a[i], b[j]> of the listed pairs, by one product where most pairs are listed."""
    if not len(i):
        return np.zeros(0)
    if len(i) * 8 > len(a) * len(b):
        return (a @ b.T)[i, j]
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)])


def matrix(values: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), dim)


def query_blocks(queries: DataFrame, seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Blocks of about BLOCK queries of one length, with a first threshold for each."""
    n = max(1, math.ceil(queries.count() / BLOCK))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "block"):
            by: dict[int, list[dict]] = {}
            for row in rows:
                by.setdefault(row["dim"], []).append(row)
            for dim, own in by.items():
                ids, x = np.array([r["vec_id"] for r in own], np.int64), matrix([r["v"] for r in own], dim)
                threshold = np.full(len(ids), -np.inf)
                if dim in seeds and len(seeds[dim][0]) > k:
                    mine, seed = Rows(ids, x), Rows(*seeds[dim])
                    scores = mine.x @ seed.x.T
                    scores = lowered(scores - slack(dim, mine.norm[:, None] * seed.norm))
                    scores[(ids[:, None] == seed.ids) | mine.wild[:, None] | seed.wild] = -np.inf
                    threshold = np.sort(scores, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((dim, pa.int32()), (ids.tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (threshold.tobytes(), pa.binary()))], ["dim", "ids", "x", "threshold"])

    rows = queries.dropDuplicates(["vec_id"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(fill, "dim int, ids binary, x binary, threshold binary")


def rounds(blocks: DataFrame) -> Iterator[list]:
    """Query blocks in groups of at most ROUND_BYTES (a block at least)."""
    held, size = [], 0
    for row in blocks.toLocalIterator():
        if held and size + len(row["x"]) > ROUND_BYTES:
            yield held
            held, size = [], 0
        held.append((row["dim"], bytes(row["ids"]), bytes(row["x"]), bytes(row["threshold"])))
        size += len(row["x"])
    if held:
        yield held


def search(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each vec_id divisible by ``every``."""
    spark = embeddings.sparkSession
    vectors = cleaned(embeddings)
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # about SEEDS rows by hash, whatever the number of tasks; their number only moves the first threshold
    share = min(1.0, SEEDS / max(1, vectors.count()))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    for dim in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == dim]
        seeds[dim] = (np.array([r["vec_id"] for r in own], np.int64), matrix([r["v"] for r in own], dim))
    blocks = materialise(query_blocks(vectors.where(F.pmod("vec_id", F.lit(every)) == 0), seeds, k), "queries")
    found = None
    for group in rounds(blocks):
        shared = spark.sparkContext.broadcast(group)
        part = materialise(scan(vectors, shared, k), "found")  # written before the next round's queries are sent
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(vectors: DataFrame, shared, k: int) -> DataFrame:
    """The k best of each task's own rows for the queries of one round."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[QueryBlock]] = {}
        for dim, ids, x, threshold in shared.value:
            blocks.setdefault(dim, []).append(QueryBlock(np.frombuffer(ids, np.int64), matrix([x], len(x) // 8).reshape(len(ids) // 8, dim), np.frombuffer(threshold), k))
        for batch in batches:
            all_ids, dims, values = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for a in range(0, len(own), 2 * BLOCK):
                    rows = own[a : a + 2 * BLOCK]
                    vectors_ = Rows(all_ids[rows], matrix([values[i] for i in rows], dim))
                    for block in blocks.get(dim, ()):
                        block.offer(vectors_)
        for block in (b for own in blocks.values() for b in own):
            q, ids, scores = block.found
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(visit, FOUND)
