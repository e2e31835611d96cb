"""N-gram Jaccard join (6): MinHash banding.

A document is the set of its n-grams of ``WORDS`` words (lower case, runs of
letters and digits); fewer words make one n-gram. Documents with equal sets
form a node; the join is between nodes, copies are counted.

1. MinHash signatures are cut into bands; the numbers of bands and rows are the
   cheapest that find a pair at the threshold with probability ``RECALL``.
2. Band hashes are shuffled. Buckets of one node drop out, and of the buckets
   with the very same members one stays. A large bucket is cut into blocks of
   about ``BLOCK`` nodes, and each pair of blocks is a task of its own.
3. A task verifies the pairs whose first common band is its own on their full
   n-gram sets. It sends no pairs: per node the number of copies it links to,
   and a spanning forest of the links.
4. Forests are joined to components by alternating star contraction.

Only texts of nodes that share a bucket are read again and moved.

Defined cases: null text counts as empty; documents without words are equal to
each other and to nothing else; null and repeated doc_ids are rows like others
(class_id is the smallest doc_id of the class, null if it has none); an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom
from .common import as_bytes, bounds, fresh, in_steps, materialise, runs, slices, small_batches, take_ranges, tidy

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9999, 128
BLOCK = 400
_WORD = re.compile(r"[^\W_]+")


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the recall with at most ``hashes`` hashes."""
    shape = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            shape = (bands, rows)
    if shape is None:
        raise ValueError("more hashes are needed for this recall")
    return shape


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """N-gram sets of texts; keeps the word hashes of tokens it has met."""

    LIMIT = 200_000

    def __init__(self, words: int = WORDS):
        self.words = words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, tokens: list[str]) -> None:
        found = [_WORD.findall(t) for t in tokens]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        digests = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in chain.from_iterable(found))
        self.starts = np.concatenate((self.starts, len(self.flat) + bounds(lens)[:-1]))
        self.lens = np.concatenate((self.lens, lens))
        self.flat = np.concatenate((self.flat, np.frombuffer(digests, "<u8")))
        self.index.update(zip(tokens, range(len(self.index), len(self.index) + len(tokens))))

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Sorted distinct n-gram hashes of each text."""
        for a, b in slices(map(len, texts), 1 << 20):
            tokens = [t.decode().lower().split() for t in texts[a:b]]
            flat = list(chain.from_iterable(tokens))
            new = sorted(set(flat).difference(self.index))
            if len(self.index) + len(new) > self.LIMIT:
                self._clear()
                new = sorted(set(flat))
            self._learn(new)
            codes = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
            each = self.lens[codes]
            hashes = take_ranges(self.flat, self.starts[codes], each)
            cuts = bounds(each)[bounds(np.fromiter(map(len, tokens), np.int64, len(tokens)))].tolist()
            with np.errstate(over="ignore"):
                n, grams = self.words, np.zeros(max(0, len(hashes) - self.words + 1), np.uint64)
                for i in range(n if len(grams) else 0):
                    grams = grams * np.uint64(_BASE) + hashes[i : len(hashes) - n + 1 + i]
                grams = mixed(grams)
                for s, e in zip(cuts, cuts[1:]):
                    if e - s >= n:
                        yield np.unique(grams[s : e - n + 1])
                    elif e > s:
                        one = np.uint64(e - s)
                        for h in hashes[s:e]:
                            one = one * np.uint64(_BASE) + h
                        yield mixed(np.array([one]))
                    else:
                        yield np.zeros(0, np.uint64)


class Bands:
    """Band hashes of an n-gram set; the band's number is part of its hash."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(1)
        self.mul = rng.integers(0, _MASK, bands * rows, np.uint64, endpoint=True) | np.uint64(1)
        self.add = rng.integers(0, _MASK, bands * rows, np.uint64, endpoint=True)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            low = np.full(len(self.mul), _MASK, np.uint64)
            for s in range(0, len(grams), 4096):
                low = np.minimum(low, (self.mul[:, None] * grams[s : s + 4096] + self.add[:, None]).min(axis=1))
            low = low.reshape(self.bands, self.rows)
            out = np.arange(1, self.bands + 1, dtype=np.uint64)
            for r in range(self.rows):
                out = mixed(out * np.uint64(_BASE) + low[:, r])
        return out.view(np.int64)


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, shape: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, node and bands of every document; written once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(words), Bands(*shape)
        for batch in in_steps(batches, 1):
            texts = as_bytes(batch.column(1))
            nodes, keys = [], []
            for grams in shingler.sets(texts):
                nodes.append(node_of(grams))
                keys.append(bands.of(grams))
            lists = pa.ListArray.from_arrays(pa.array(bounds(np.array([len(k) for k in keys], np.int64)), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array(nodes, pa.binary()), lists], ["doc_id", "text_key", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return materialise(rows.mapInArrow(tidy(sign), "doc_id bigint, text_key binary, node binary, bands array<bigint>"), "signatures")


def bucket_tasks(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """task, key, side, node: who has to be compared with whom, in blocks."""
    hashed = nodes.select("node", F.explode("bands").alias("key"))
    a, b = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    # of the buckets with the same members, the one of the earliest band stays
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    same = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"), F.min("band").alias("band")).where("n > 1")
    kept = materialise(same.groupBy("n", "a", "b").agg(F.min(F.struct("band", "key")).alias("m")).select(F.col("m.key").alias("key"), "n"), "buckets")
    members = hashed.join(kept, "key")
    count = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = members.select("key", "node", count.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(2)), count).cast("int").alias("mine"))
    each = own.select("key", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return each.select(F.concat_ws(":", F.col("key").cast("string"), low.cast("string"), high.cast("string")).alias("task"), "key", (F.col("mine") > F.col("other")).alias("side"), (low == high).alias("whole"), "node")


def gram_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, grams of the needed nodes (text_key, node, ...), read from one text each."""
    key, maybe = "text_key", bloom(needed, "text_key")
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias(key), "text")
    once = texts.where(maybe(key)).groupBy(key).agg(F.first("text").alias("text"))
    wanted = once.join(needed, key).select("node", "copies", "bands", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in in_steps(batches, 3):
            sets = [g.tobytes() for g in shingler.sets(as_bytes(batch.column(3)))]
            keys = [np.array(b, np.int64).tobytes() for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["node", "copies", "keys", "grams"])

    return materialise(wanted.mapInArrow(tidy(shingle), "node binary, copies bigint, keys binary, grams binary"), "gram-sets")


def links_of(rows: list[dict], threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(node, root of its links here, copies it links to) of one task."""
    nodes = [r["node"] for r in rows]
    key, copies = rows[0]["key"], [r["copies"] for r in rows]
    bands = np.stack([np.frombuffer(r["keys"], np.int64) for r in rows])
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, flag = bounds(size), np.zeros(len(names), np.int32)
    side, whole = np.array([r["side"] for r in rows]), rows[0]["whole"]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        near = (size * threshold <= size[i] + 1e-9) & (size + 1e-9 >= threshold * size[i])
        near &= (np.arange(len(rows)) > i) if whole else (side & (not side[i]))
        js = np.flatnonzero(near)
        if not len(js):
            continue
        equal = bands[js] == bands[i]
        js = js[bands[i][equal.argmax(axis=1)] == key]  # other pairs belong to an earlier band
        if not len(js):
            continue
        flag[flat[starts[i] : starts[i + 1]]] = 1
        each = size[js]
        common = np.add.reduceat(flag[take_ranges(flat, starts[js], each)], bounds(each)[:-1])
        flag[flat[starts[i] : starts[i + 1]]] = 0
        for j in js[common >= threshold * (each + size[i] - common) - 1e-9].tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return [(nodes[i], nodes[top(i)], links[i]) for i in range(len(rows)) if links[i]]


def verified(tasks: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, root, links: the verified links of every task, without pairs."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "task"):
            if out := links_of(rows, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))], ["node", "root", "links"])

    rows = tasks.join(sets, "node").repartition("task").sortWithinPartitions("task", "node")
    return materialise(rows.mapInArrow(tidy(check), "node binary, root binary, links bigint"), "links")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its smallest node) of all nodes that have an edge (u, v)."""
    now, last = materialise(edges.where("u != v").select("u", "v").distinct(), "edges"), None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-low")
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        joined = large.join(least, "u")
        now = materialise(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = state
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, component and n_links of every document; written once."""
    small_batches(docs.sparkSession)
    signed = signatures(docs, words, band_shape(threshold))
    grouped = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"))
    nodes = materialise(grouped, "nodes")
    tasks = materialise(bucket_tasks(nodes), "tasks")
    needed = materialise(nodes.join(tasks.select("node").distinct(), "node", "left_semi").select("node", "text_key", "copies", "bands"), "needed")
    found = verified(tasks, gram_sets(docs, needed, words), threshold)
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = joined.join(linked, "node", "left")
    full = nodes.select("node", "copies", "low").join(known, "node", "left").select(
        "node", "low", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    full = materialise(full, "node-classes")
    ids = full.groupBy("component").agg(F.min("low").alias("class_id"))
    named = materialise(full.join(ids, "component").select("node", "component", "class_id", "n_links"), "class-ids")
    return signed.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "component", "class_id", "n_links")


def near_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links (documents of similarity at or over the threshold) of every document."""
    return classes(docs, words, threshold).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that a class has besides its smallest doc_id."""
    key, maybe = fresh(docs, "text_key", "maybe")
    rows = materialise(classes(docs).where("n_links > 0").select("component", "doc_id", "text_key"), "linked-documents")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keepers = materialise(rows.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.text_key").alias("k_key")), "keepers")
    members = materialise(rows.select(F.col("text_key").alias("m_key")).distinct(), "member-keys")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    tested = keyed.withColumn(maybe, bloom(members, "m_key")(key))
    suspects = tested.where(F.col(maybe))
    clear = suspects.join(members, F.col(key) == F.col("m_key"), "left_anti")
    chosen = suspects.join(keepers, (F.col(key) == F.col("k_key")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi").dropDuplicates([key, "doc_id"])
    return tested.where(~F.col(maybe)).select(*docs.columns).unionByName(clear.select(*docs.columns)).unionByName(chosen.select(*docs.columns))
