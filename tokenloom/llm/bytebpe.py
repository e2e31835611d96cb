"""Byte-level BPE encoding and decoding (2): a shuffle of the distinct words.

1. Texts are cut into pre-tokens (words) by the tokenizer's pattern. Positions
   stay with the document: a chunk of documents keeps the sequence of its word
   numbers, and its distinct words leave as packs, one per hash bucket. A word
   that makes up a third of the corpus is one entry per chunk.
2. Packs are shuffled by bucket; each distinct word is encoded once.
3. Ids go back to their chunk, are joined with the sequences by word number,
   and reassembled by position.

Decoding joins each id with the table of token bytes (fixed size, in every
worker) and concatenates by position.

Pieces of text between single spaces are cut by the pattern once per chunk; a
cut in front of a space that a non-space follows is always a word border.

Defined cases: null text counts as empty and has no ids; null and repeated
doc_ids give one row each; very long texts and words are encoded whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounds, in_steps, list_array, list_parts, partitions, runs, slices, squeeze, take_ranges, unsqueeze, unvarint, varint

RANKS_FILE = "byte_bpe_50k.tiktoken"
CHUNK_BYTES = 12 << 20
STEP_BYTES = 1 << 20
SPACE = r"\p{White_Space}"
PACK_SCHEMA = "chunk bigint, bucket int, route bigint, words binary, doc_ids array<bigint>, doc_words binary, sequence binary, word_buckets binary"


def ranks(path: str | None = None) -> dict[bytes, int]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS_FILE)
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def word_pattern(pattern: str | None = None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern.replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}")  # white space as the library has it


def encoding(table: dict[bytes, int], pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


class Numbers(dict):
    """Numbers its keys in order of arrival."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Cutter:
    """Cuts texts into words, keeping the words of every piece it has met."""

    def __init__(self, pattern: str):
        self.words = regex.compile(pattern)
        self.double = regex.compile(f"{SPACE}{SPACE}")
        self.cut = regex.compile(rf"(?V1)(?= \P{{White_Space}})")
        self.pieces = Numbers()

    def piece_numbers(self, text: str) -> list[int]:
        """A piece after a space has the text behind it as key; any other, a tuple."""
        if not text:
            return []
        if self.double.search(text):
            keys = [p[1:] if p[0] == " " else (p,) for p in self.cut.split(text) if p]
        else:
            keys = text.split(" ")
            first = keys[0]
            keys[0] = (first,)
            if not first:
                del keys[0]
        return list(map(self.pieces.__getitem__, keys))

    def piece_words(self) -> tuple[Numbers, np.ndarray, np.ndarray]:
        """Distinct words, and the word numbers of every piece with their counts."""
        found, vocabulary = [self.words.findall(p[0] if type(p) is tuple else f" {p}") for p in self.pieces], Numbers()
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return vocabulary, np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(found)), np.int64, int(lens.sum())), lens


def pack(lens: list[int], parts: list[bytes]) -> bytes:
    """Count, lengths and content of the parts, compressed."""
    return squeeze(len(lens).to_bytes(4, "little") + varint(np.array(lens, np.int64)) + b"".join(parts))


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:4], "little")
    end = 4 + int(np.flatnonzero(np.frombuffer(raw, np.uint8, min(5 * n, len(raw) - 4), 4) < 128)[n - 1]) + 1 if n else 4
    return unvarint(raw[4:end]), raw[end:]


def chunk_rows(chunk: int, cutter: Cutter, ids: list, sequences: list[np.ndarray], buckets: int) -> Iterator[dict]:
    """The chunk's own row (bucket -1) and one pack of distinct words per bucket."""
    vocabulary, flat, each = cutter.piece_words()
    starts, words, per_doc = bounds(each), [], []
    for a, b in slices(map(len, sequences), STEP_BYTES // 4):  # in steps, for the memory
        pieces = np.concatenate(sequences[a:b])
        words.append(take_ranges(flat, starts[pieces], each[pieces]).astype(np.int32))
        per_doc.append(np.diff(bounds(each[pieces])[bounds(np.fromiter(map(len, sequences[a:b]), np.int64, b - a))]))
    # frequent words get small numbers, so sequences stay short
    count = sum((np.bincount(w, minlength=len(vocabulary)) for w in words), np.zeros(len(vocabulary), np.int64))
    order = np.argsort(-count, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    names = list(vocabulary)
    names = [names[i].encode() for i in order.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int32, len(names))
    sequence = b"".join(varint(number[w]) for w in words)
    yield {"chunk": chunk, "bucket": -1, "route": chunk, "doc_ids": ids, "doc_words": squeeze(varint(np.concatenate(per_doc))), "sequence": squeeze(sequence), "word_buckets": squeeze(bucket.astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes())}
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
        entry = [names[i] for i in by[a:b].tolist()]
        yield {"chunk": chunk, "bucket": int(bucket[by[a]]), "route": int(bucket[by[a]]), "words": pack(list(map(len, entry)), entry)}


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""
    table, cut_by = ranks(path), word_pattern(pattern)
    kind = "<u2" if max(table.values()) < 1 << 16 else "<u4"
    buckets = max(512, 8 * partitions(docs.sparkSession))
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("route", pa.int64()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.binary()), ("sequence", pa.binary()), ("word_buckets", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total, cutter = TaskContext.get().partitionId() << 24, 0, Cutter(cut_by)
        ids, sequences = [], []
        for batch in in_steps(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids.append(doc_id)
                sequences.append(np.array(cutter.piece_numbers(text.decode()), np.int32))
                total += len(text)
                if total >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(list(chunk_rows(chunk, cutter, ids, sequences, buckets)), schema)
                    chunk, total, cutter = chunk + 1, 0, Cutter(cut_by)
                    ids, sequences = [], []
        if ids:
            yield pa.RecordBatch.from_pylist(list(chunk_rows(chunk, cutter, ids, sequences, buckets)), schema)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, known = None, None, {}
        for batch in batches:
            coder, out = coder or encoding(table), []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(3)):
                if bucket < 0:
                    out.append(None)  # a chunk's own row passes by
                    continue
                if bucket != now:
                    now, known = bucket, {}
                lens, raw = unpack(packed.as_py())
                cuts, ids = bounds(lens).tolist(), []
                for a, b in zip(cuts, cuts[1:]):
                    word = raw[a:b]
                    if word not in known:
                        known[word] = np.array(coder._encode_single_piece(word), kind).tobytes()
                    ids.append(known[word])
                out.append(pack([len(i) // int(kind[-1]) for i in ids], ids))
            yield batch.set_column(3, "words", pa.array(out, pa.binary()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "chunk"):
            head, packs = rows[0], rows[1:]
            counts, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            bucket = np.frombuffer(unsqueeze(head["word_buckets"]), "<u2" if buckets <= 1 << 16 else "<u4")
            for row in packs:
                lens, raw = unpack(row["words"])
                counts.append(lens)
                flats.append(np.frombuffer(raw, kind).astype(np.int32))
            count, flat = np.concatenate(counts), np.concatenate(flats)
            place = np.empty(len(bucket), np.int64)
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))  # word number -> its entry in the packs
            starts = bounds(count)
            words = unvarint(unsqueeze(head["sequence"]))
            per_doc = unvarint(unsqueeze(head["doc_words"]))
            cuts = bounds(per_doc)
            for a, b in slices(per_doc.tolist(), STEP_BYTES // 4):
                entries = place[words[cuts[a] : cuts[b]]]
                each = count[entries]
                lens = np.diff(bounds(each)[cuts[a : b + 1] - cuts[a]])
                yield pa.RecordBatch.from_arrays([pa.array(head["doc_ids"][a:b], pa.int64()), list_array(take_ranges(flat, starts[entries], each), lens, pa.int32())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    packs = rows.mapInArrow(split, PACK_SCHEMA)
    # one shuffle brings the packs of a bucket together, the next one those of a chunk
    coded = packs.repartition("route").sortWithinPartitions("bucket").mapInArrow(encode_words, PACK_SCHEMA)
    return coded.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(assemble, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The frame with ``bytes``: the token bytes of ``ids``, joined by position.

    The token-byte table has one entry per rank (fixed size); every worker has
    it whole, so ids are joined with it in place.
    """
    table = ranks(path)
    tokens = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token

    @F.arrow_udf(T.BinaryType())
    def join_bytes(ids: pa.Array) -> pa.Array:
        get, parts = tokens.__getitem__, []
        for a in range(0, max(1, len(ids)), 500):
            flat, lens = list_parts(ids.slice(a, 500))
            cuts = bounds(lens).tolist()
            parts.append(pa.array([b"".join(map(get, flat[x:y].tolist())) for x, y in zip(cuts, cuts[1:])], pa.binary()))
        return pa.concat_arrays(parts)

    return coded.withColumn("bytes", join_bytes("ids"))


def round_trip(docs: DataFrame) -> DataFrame:
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
