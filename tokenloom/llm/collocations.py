"""Phrase collocation mining (11): n-grams counted over a prefix-free parse.

1. Every text is cut into chunks where a word's hash is a multiple of
   ``TRIGGER``; since content decides, repeated passages give the same chunks.
   A chunk holds its own words and, in the same piece, the next ``longest`` - 1
   words. The dictionary has each distinct chunk of a language once, with its
   frequency; copies and repeated passages are counted from here on, not read.
2. An n-gram belongs to the chunk that owns its first word, so overlaps are
   assigned once. Distinct chunks are parsed, each n-gram weighted by the
   frequency of its chunk.
3. Counting takes two passes over the dictionary. The first adds up 48-bit
   hashes, split by hash range, and keeps those with ``least`` occurrences or
   more: no frequent n-gram is missed. The second counts the n-grams behind
   them as text, so the result is exact whatever hashes meet.
4. Candidates find the counts of their parts by joins on text.

The hashes kept are broadcast as a bit table of at most ``MAX_BITS`` bits; more
of them are taken in rounds of hash ranges, each with a table of its own.

Forms: A-Z count as a-z; ``.,;:!?`` and line ends (U+000A to U+000D) end a
piece, blanks and tabs a word. Defined cases: null text counts as empty, null
lang as ``und``; rows without ids, repeated rows and extra columns count like
others; an empty table gives no phrases. Texts over ``LONG`` bytes are parsed in
parts that end with a piece; a single piece is held whole. Counts are exact up
to 10**16.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import flat, mix, runs_of, word_hashes
from .common import as_bytes, bounds, in_steps, materialise, partitions, runs, small_batches, take_ranges

TRIGGER, LONGEST_CHUNK = 16, 4096
LONG, STEP = 4 << 20, 1 << 20
HASH_BITS = 48
FLUSH, BUCKET = 2_000_000, 2_000_000  # n-grams a message, n-grams a hash range
BITS_PER_GRAM, MAX_BITS = 16, 1 << 29
PARTS = 8  # parts of a language that are ranked apart

_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_TEXT_KIND = np.zeros(256, np.uint8)
_TEXT_KIND[list(b" \t")] = 1
_TEXT_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
# in the dictionary a blank ends a word, \r the last own word and \n a piece
_CHUNK_KIND = np.zeros(256, np.uint8)
_CHUNK_KIND[list(b" \r")] = 1
_CHUNK_KIND[list(b"\n")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FAST = pa.Codec("zstd", compression_level=1)


def _words(buf: np.ndarray, cuts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and piece of every word."""
    kinds = kind[buf]
    starts, ends = runs_of(kinds == 0)
    piece = np.searchsorted(np.flatnonzero(kinds == 2), starts)
    return starts, ends, np.searchsorted(cuts, starts, side="right") - 1, piece


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > LONG:
        found = _PIECE_END.search(data, at + LONG)
        if not found:
            break
        yield data[at : found.end()]
        at = found.end()
    yield data[at:]


def _text_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of a step; a long text is a step a part."""
    for batch in in_steps(batches, 1, STEP):
        lang, text = batch.column(0), batch.column(1).fill_null("")
        if (pc.max(pc.binary_length(text)).as_py() or 0) <= LONG:
            yield lang, text
            continue
        for one, data in zip(lang, as_bytes(text)):
            for part in _parts(data):
                yield pa.array([one.as_py()], lang.type), pa.array([part], pa.binary()).cast(pa.string())


def parse(lang: pa.Array, text: pa.Array, longest: int) -> pa.RecordBatch:
    """The chunks of a step: lang, chunk and its number of own words."""
    raw, cuts = flat(pc.binary_join_element_wise(text, "", "\n"))  # every text ends with a piece
    buf = _LOWER[raw]
    starts, ends, row, piece = _words(buf, cuts, _TEXT_KIND)
    at = np.arange(len(starts))
    begin = word_hashes(buf, starts, ends) % np.uint64(TRIGGER) == 0
    begin |= np.diff(row, prepend=-1) != 0
    begin |= (at - np.maximum.accumulate(np.where(begin, at, 0))) % LONGEST_CHUNK == 0
    first = np.flatnonzero(begin)
    own = np.diff(first, append=len(at))
    after = first + own  # the words from here on are another chunk's
    more = np.clip(np.searchsorted(piece, piece[after - 1], side="right") - after, 0, longest - 1)

    lens = ends - starts + 1
    words, o = take_ranges(buf, starts, lens), bounds(lens)
    words[o[1:] - 1] = np.where(np.diff(piece, append=-1) == 0, 32, 10)
    begins = np.column_stack((o[first], o[after])).ravel()
    sizes = np.column_stack((o[after] - o[first], o[after + more] - o[after])).ravel()
    out, c = take_ranges(words, begins, sizes), bounds(sizes)
    out[c[1::2][more > 0] - 1] = 13
    out[c[2::2] - 1] = np.where(more > 0, 10, out[c[2::2] - 1])
    chunk = pa.StringArray.from_buffers(len(first), pa.py_buffer(c[::2].astype(np.int32)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([lang.take(pa.array(row[first])), chunk, pa.array(own, pa.int32())], ["lang", "chunk", "own"])


def dictionary(docs: DataFrame, longest: int) -> DataFrame:
    """lang, chunk, own, n: every distinct chunk of a language with its frequency; written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _text_steps(batches):
            yield parse(lang, text, longest)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    chunks = rows.mapInArrow(cut, "lang string, chunk string, own int")
    return materialise(chunks.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("n")), "phrase-dictionary")


def _gram_steps(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple]:
    """Per step: bytes, word starts and ends, row, weight of a row, languages; per length first words and hashes."""
    for batch in in_steps(batches, 1, STEP):
        buf, cuts = flat(batch.column(1))
        starts, ends, row, piece = _words(buf, cuts, _CHUNK_KIND)
        own, n = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3))
        owned = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row] < own[row]
        lang = batch.column(0).dictionary_encode()
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()], np.uint64)
        code = np.asarray(lang.indices)
        words = word_hashes(buf, starts, ends)
        grams, h = [], mix(words + seeds[code[row]])
        for size in range(1, longest + 1):
            if size > 1:
                h = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[size - 1 :])
            end = len(words) - size + 1
            at = np.flatnonzero(owned[: max(end, 0)] & (piece[: max(end, 0)] == piece[size - 1 :]))
            grams.append((at, h[at] >> np.uint64(64 - HASH_BITS)))
        yield buf, starts, ends, row, n, code, lang.dictionary, grams


def _add_up(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(first) else n


def _pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes by byte planes, whose high ones compress well, and saturated counts."""
    planes = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].T
    return _FAST.compress(planes.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    width = HASH_BITS // 8
    raw = np.frombuffer(_FAST.decompress(data, decompressed_size=size * (width + 4)), np.uint8)
    h = np.zeros((size, 8), np.uint8)
    h[:, :width] = raw[: size * width].reshape(width, size).T
    return h.view("<u8").ravel(), np.ascontiguousarray(raw[size * width :].reshape(4, size).T).view("<u4").ravel().astype(np.int64)


def frequent_hashes(chunks: DataFrame, buckets: int, longest: int, least: int) -> DataFrame:
    """bucket, n, hashes: per hash range the hashes with at least ``least`` occurrences; written once."""
    shift = np.uint64(HASH_BITS - buckets.bit_length() + 1)

    def messages(h: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = _add_up(np.concatenate(h), np.concatenate(n))
        counts = np.minimum(counts, least)  # enough to decide
        cuts = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, e - a, _pack(hashes[a:e], counts[a:e])) for b, (a, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if e > a]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "n", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, held = [], [], 0
        for *_, row, weight, _, _, grams in _gram_steps(batches, longest):
            for at, hashes in grams:
                h.append(hashes)
                n.append(weight[row[at]])
                held += len(at)
            if held >= FLUSH:
                yield messages(h, n)
                h, n, held = [], [], 0
        if held:
            yield messages(h, n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in runs(batches, "bucket"):
            parts = [_unpack(r["data"], r["n"]) for r in rows]
            hashes, counts = _add_up(*(np.concatenate(x) for x in zip(*parts)))
            kept = hashes[counts >= least]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(kept)], pa.int32()), pa.array([kept.astype("<u8").tobytes()], pa.binary())], ["bucket", "n", "hashes"])

    sent = chunks.mapInArrow(send, "bucket int, n int, data binary")
    dealt = sent.repartition(partitions(chunks.sparkSession), "bucket").sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(gather, "bucket int, n int, hashes binary"), "phrase-hashes")


def _places(h: np.ndarray, shift: np.uint64, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each hash, both in the segment of its bucket."""
    base = (h >> shift) * np.uint64(width)
    return base + (h & np.uint64(width - 1)), base + (mix(h) & np.uint64(width - 1))


def bit_table(hot: DataFrame, low: int, high: int, width: int, shift: np.uint64) -> np.ndarray:
    """Bits of the buckets [low, high), ``width`` each; at most ``MAX_BITS`` in all."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bits = np.zeros(width, bool)
                for place in _places(np.frombuffer(r["hashes"], "<u8"), shift, width):
                    bits[(place - np.uint64(r["bucket"] * width)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])

    table = np.zeros((high - low) * width // 8, np.uint8)
    for r in hot.where(F.col("bucket").between(low, high - 1)).mapInArrow(segments, "bucket int, bits binary").collect():
        at = (r["bucket"] - low) * width // 8
        table[at : at + width // 8] = np.frombuffer(r["bits"], np.uint8)
    return table


def exact_counts(chunks: DataFrame, hot: DataFrame, buckets: int, longest: int, least: int) -> DataFrame:
    """lang, words, gram, f: every n-gram with at least ``least`` occurrences; written once."""
    spark, shift = chunks.sparkSession, np.uint64(HASH_BITS - buckets.bit_length() + 1)
    total = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = max(64, 1 << max(0, BITS_PER_GRAM * -(-total // buckets) - 1).bit_length())
    step = max(1, min(buckets, MAX_BITS // width))  # buckets a round
    out = None
    for low in range(0, buckets, step):
        high = min(buckets, low + step)
        shared = spark.sparkContext.broadcast(bit_table(hot, low, high, width, shift))

        def count(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high, shared=shared) -> Iterator[pa.RecordBatch]:
            table, held = shared.value, {}

            def test(h: np.ndarray) -> np.ndarray:
                found = np.ones(len(h), bool) if (low, high) == (0, buckets) else (h >> shift >= np.uint64(low)) & (h >> shift < np.uint64(high))
                for place in _places(h, shift, width):
                    p = np.where(found, place - np.uint64(low * width), 0)
                    found &= (table[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                return found

            def rows() -> pa.RecordBatch:
                keys = [(lang, size, len(c)) for (lang, size), c in held.items()]
                reps = [k[2] for k in keys]
                columns = [
                    pa.array(np.repeat(np.array([k[0] for k in keys], object), reps), pa.string()), pa.array(np.repeat([k[1] for k in keys], reps), pa.int32()),
                    pa.array([g for c in held.values() for g in c], pa.binary()).cast(pa.string()), pa.array([f for c in held.values() for f in c.values()], pa.int64()),
                ]
                held.clear()
                return pa.RecordBatch.from_arrays(columns, ["lang", "words", "gram", "f"])

            for buf, starts, ends, row, weight, code, langs, grams in _gram_steps(batches, longest):
                data = buf.tobytes().replace(b"\r", b" ")
                for size, (at, h) in enumerate(grams, 1):
                    at = at[test(h)]
                    for one in np.unique(code[row[at]]):
                        mine = at[code[row[at]] == one]
                        seen = held.setdefault((langs[int(one)].as_py(), size), {})
                        get = seen.get
                        for a, e, n in zip(starts[mine].tolist(), ends[mine + size - 1].tolist(), weight[row[mine]].tolist()):
                            gram = data[a:e]
                            seen[gram] = get(gram, 0) + n
                if sum(map(len, held.values())) > 300_000:
                    yield rows()
            if held:
                yield rows()

        counted = chunks.mapInArrow(count, "lang string, words int, gram string, f long").groupBy("lang", "words", "gram").agg(F.sum("f").alias("f"))
        part = materialise(counted.where(F.col("f") >= least), "phrase-counts")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def frequent_grams(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, words, gram, f) of all n-grams of 1 to ``longest`` words with ``least`` occurrences, and (lang, n) of words."""
    small_batches(docs.sparkSession)
    chunks = dictionary(docs, longest)
    words = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    size = chunks.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0] * longest
    buckets = 1 << max(size // BUCKET, 8 * partitions(docs.sparkSession)).bit_length()
    hot = frequent_hashes(chunks, buckets, longest, least)
    return exact_counts(chunks, hot, buckets, longest, least), words


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """The best ``top`` phrases of 2 to ``longest`` words of every language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut that scores lowest
    (10**6 a a / (l r), rounded down). A phrase goes if a longer one that holds it
    has at least ``share`` percent of its occurrences.
    """
    grams, words = frequent_grams(docs, longest, least)
    phrases = grams.where("words >= 2").select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"), F.split("gram", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(grams.select("lang", F.col("gram").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = phrases.where("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("p", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    longer = inner.select("lang", part(F.col("p"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("low.score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of each of its parts, so a hot language is ranked by many tasks first
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    parts = kept.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")
