"""Document fingerprints (13): MinHash.

A document is the set of its shingles of ``WORDS`` words (runs of ASCII letters
and digits and of all other letters' bytes, A-Z as a-z); fewer words make one
shingle. Each of ``HASHES`` universal hash functions a x + b permutes the
shingles' 32-bit values; the smallest value of each is one component, 16 bits of
which are kept. The share of equal components of two fingerprints estimates the
Jaccard similarity of the sets. All of it runs in numpy over whole batches.

``neighbours`` compares every document with the document that follows it by
doc_id and with an edited text of its own. Documents are dealt into ranges of
doc_ids and sorted there; only the first document of each range is sent twice,
so that the last one before it finds its successor.

``representatives`` joins bands of the signatures in Spark: every distinct
fingerprint meets the smallest of each of its buckets, at most ``BANDS`` of them
however large a bucket is, and the pairs are verified on the full shingle sets.

Defined cases: null text counts as empty; documents without words have one
fingerprint and likeness 1 to each other, 0 to others; null doc_ids come first,
rows of one doc_id are ordered by text and follow each other; a single row
follows itself; an empty table gives no rows; extra columns are ignored. A text
is held whole with the hashes of its words; rows of one doc_id are in one range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import flat, mix, runs_of, word_hashes
from .common import as_bytes, bounds, in_steps, list_parts, materialise, partitions, small_batches

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5  # a pair at the threshold shares a band with probability 0.9999
HASHES = BANDS * ROWS
STEP, BLOCK = 1 << 20, 1 << 15
RANGES = 4  # doc_id ranges a shuffle partition

_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _IN_WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _functions() -> np.ndarray:
    """Multiplier and summand of each hash function."""
    return np.random.default_rng(13).integers(0, 1 << 64, (HASHES, 2), np.uint64)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, in order, and how many each text has."""
    buf, cuts = flat(pa.array([t + b"\n" for t in texts], pa.large_binary()))
    starts, ends = runs_of(_IN_WORD[buf])
    row = np.searchsorted(cuts, starts, side="right") - 1
    hashes = word_hashes(_LOWER[buf], starts, ends)
    count = np.bincount(row, minlength=len(texts))
    grams, grown = [], mix(hashes)
    few = np.zeros(len(texts), np.uint64)
    first = bounds(count)[:-1]
    for size in range(1, words + 1):
        if size > 1:
            grown = mix(grown[:-1] * _NEXT + hashes[size - 1 :])
        if size < words:
            short = count == size
            few[short] = grown[first[short]]
        elif len(grown):
            grams = grown[row[: len(grown)] == row[size - 1 :]]
    lens = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    out = np.zeros(int(lens.sum()), np.uint64)
    single = (count > 0) & (count < words)
    at = np.zeros(len(out), bool)
    at[bounds(lens)[:-1][single]] = True
    out[at] = few[single]
    out[~at] = grams
    return out, lens


def signatures(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Texts x ``HASHES`` smallest 32-bit hash values; all ones without shingles."""
    out = np.full((len(lens), HASHES), 0xFFFFFFFF, np.uint32)
    some, cuts = np.flatnonzero(lens), bounds(lens[lens > 0])
    a, functions = 0, _functions()
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + BLOCK, side="right")) - 1)
        x = values[cuts[a] : cuts[b]] >> np.uint64(32)
        starts, y, low = cuts[a:b] - cuts[a], np.empty_like(x), np.empty((HASHES, b - a), np.uint64)
        for i, (mul, add) in enumerate(functions):
            np.multiply(x, mul, out=y)
            np.add(y, add, out=y)
            np.minimum.reduceat(y, starts, out=low[i])
        out[some[a:b]] = (low >> np.uint64(32)).T
        a = b
    return out


def components(signature: np.ndarray) -> np.ndarray:
    """The 16 bits of each component that a fingerprint keeps."""
    return (mix(signature.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal components, row by row."""
    return (one == other).mean(axis=1) if len(one) else np.zeros(0)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band; its number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        out = mix(out * _NEXT + parts[:, :, r])
    return out.view(np.int64)


def jaccard(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Similarity of the shingle sets, row by row; hashes share 64 bits with the row's number."""
    rows = len(one[1])
    room = np.uint64(max(1, rows.bit_length()))

    def keys(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return np.unique(np.repeat(np.arange(rows, dtype=np.uint64), lens) << (np.uint64(64) - room) | values >> room)

    both = np.sort(np.concatenate((keys(*one), keys(*other))))
    shared = np.flatnonzero(both[1:] == both[:-1])
    at = (both >> (np.uint64(64) - room)).astype(np.int64)
    total, common = np.bincount(at, minlength=rows), np.bincount(at[shared], minlength=rows)
    return np.where(total > 0, common / np.maximum(total - common, 1), 1.0)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def edited_text(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many from the start of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


NEIGHBOUR_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, bands_edited int, jaccard_edited double"
)


def _compared(ids: pa.Array, texts: list[str], follows: list[str], sets: tuple, signed: np.ndarray, next_signed: np.ndarray) -> pa.RecordBatch:
    edited = [edited_text(a, b).encode() for a, b in zip(texts, follows)]
    other = shingles(edited)
    edited_signed = signatures(*other)
    mine, theirs = components(signed), components(edited_signed)
    columns = [
        ids.cast(pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()), _hex(mine), _hex(theirs),
        pa.array(likeness(mine, theirs), pa.float64()), pa.array(likeness(mine, components(next_signed)), pa.float64()),
        pa.array((bands(signed) == bands(edited_signed)).sum(axis=1), pa.int32()), pa.array(jaccard(sets, other), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NEIGHBOUR_SCHEMA.split(", ")])


def _split(sets: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, lens = sets
    return values[np.repeat(rows, lens)], lens[rows]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, last, doc_id, text) in order; the row marked ``last`` only closes its range."""
    held = None  # the last row, which waits for its successor
    for batch in in_steps(batches, 3, STEP):
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        text = as_bytes(batch.column(3))
        sets = shingles(text)
        signed = signatures(*sets)
        last = np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
        rows = np.flatnonzero(~last[:-1])
        if len(rows):
            strings = [t.decode() for t in text]
            of = np.zeros(len(text), bool)
            of[rows] = True
            yield _compared(batch.column(2).take(pa.array(rows)), [strings[i] for i in rows], [strings[i + 1] for i in rows], _split(sets, of), signed[rows], signed[rows + 1])
        held = batch.slice(batch.num_rows - 1)


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and their likeness and the next document's."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids, n = rows.select("doc_id"), RANGES * partitions(spark)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bound = np.array(sorted(set(cuts or [])), np.int64)  # one value a range

    @F.arrow_udf("int")
    def place(doc_id: pa.Array) -> pa.Array:
        known = np.searchsorted(bound, np.asarray(doc_id.fill_null(0)), side="right")
        return pa.array(np.where(np.asarray(doc_id.is_null()), 0, known), pa.int32())

    # the first row of each range also closes the range before it
    dealt = rows.withColumn("range", place("doc_id"))
    firsts = ids.withColumn("range", place("doc_id")).groupBy("range").agg(F.min(F.struct("doc_id")).alias("f")).select("range", "f.doc_id").collect()
    firsts.sort(key=lambda r: r["range"])
    closes = spark.createDataFrame([(firsts[i - 1]["range"], r["doc_id"]) for i, r in enumerate(firsts)], "range int, first bigint")
    starts = rows.join(F.broadcast(closes), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    closing = starts.select("range", F.lit(True).alias("last"), "f.doc_id", "f.text")
    both = dealt.select("range", F.lit(False).alias("last"), "doc_id", "text").unionByName(closing)
    ordered = both.repartition(partitions(spark), "range").sortWithinPartitions("range", "last", F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(_walk, NEIGHBOUR_SCHEMA)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (of the fingerprint), bands and the text's MD5 of every document; written once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 1, STEP):
            text = as_bytes(batch.column(1))
            signed = signatures(*shingles(text))
            node = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in components(signed)]
            found = bands(signed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(found.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), lists, pa.array([hashlib.md5(t).digest() for t in text], pa.binary())], ["doc_id", "node", "bands", "key"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(rows.mapInArrow(sign, "doc_id bigint, node binary, bands array<bigint>, key binary"), "sketches")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, representative, similarity of every document.

    The representative of a fingerprint is the smallest one of its buckets whose
    shingle set is similar enough, or itself; it is named by its smallest doc_id.
    Rows of one fingerprint count as one; op6 is the join that finds every pair.
    """
    small_batches(docs.sparkSession)
    signed = sketches(docs)
    nodes = materialise(signed.groupBy("node").agg(F.min("doc_id").alias("name"), F.min("key").alias("key"), F.first("bands").alias("bands")), "sketch-nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    low = banded.groupBy("band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "low")
    pairs = materialise(banded.join(low, "band").where("node > low").select("node", "low").distinct(), "sketch-pairs")
    wanted = pairs.select("node").union(pairs.select("low")).distinct()

    @F.arrow_udf("array<long>")
    def grams(text: pa.Array) -> pa.Array:
        values, lens = shingles(as_bytes(text))
        return pa.ListArray.from_arrays(pa.array(bounds(lens), pa.int32()), pa.array(values.view(np.int64)))

    @F.arrow_udf("double")
    def similar(one: pa.Array, other: pa.Array) -> pa.Array:
        sets = [(flat_values.view(np.uint64), lens) for flat_values, lens in (list_parts(one), list_parts(other))]
        return pa.array(jaccard(*sets), pa.float64())

    keys = nodes.join(wanted, "node", "left_semi").select("node", "key")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    once = texts.join(keys, "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialise(once.select("node", grams("text").alias("grams")), "sketch-sets")
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("low"), F.col("grams").alias("low_grams")), "low")
    checked = both.select("node", "low", similar("grams", "low_grams").alias("similarity")).where(F.col("similarity") >= threshold)
    best = materialise(checked.groupBy("node").agg(F.min(F.struct("low", "similarity")).alias("b")).select("node", "b.low", "b.similarity"), "sketch-links")
    named = nodes.select("node", "name").join(best, "node", "left").join(nodes.select(F.col("node").alias("low"), F.col("name").alias("low_name")), "low", "left")
    chosen = named.select("node", F.when(F.col("similarity").isNull(), F.col("name")).otherwise(F.col("low_name")).alias("representative"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return signed.select("doc_id", "node").join(chosen, "node").select("doc_id", "representative", "similarity")
