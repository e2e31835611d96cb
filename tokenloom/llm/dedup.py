"""Exact dedup (1): two-pass Bloom filtering.

Pass one hashes every text and marks, in a bit table spread over segments,
each position that two or more rows hit. All positions of a repeated hash are
marked, so the marks are a Bloom filter of the possibly repeated hashes without
misses. Pass two tests every row: rows outside the filter are unique and pass
straight through; only the others are shuffled and grouped on the full SHA-256.
``drop_copies`` runs both passes on digests alone, so that no copy of the texts
is written; a filter of the digests found repeated then splits the documents.

The broadcast filter has a bounded size (see ``bloom``); a larger table is taken
in rounds of hash ranges, so unique rows pass straight through at every size.

Defined cases: null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the largest doc_id stays (null ids lose, and a
group of null ids only keeps one row with keep_id null); of repeated rows with
that doc_id one stays; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import membership, tested
from .common import as_bytes, fresh, materialise, small_batches


def digests(text: pa.Array) -> list[bytes]:
    """SHA-256 of the text with A-Z in lower case (bytes.lower changes ASCII only)."""
    return [hashlib.sha256(x.lower()).digest() for x in as_bytes(text)]


@F.arrow_udf(T.BinaryType())
def text_sha(text: pa.Array) -> pa.Array:
    return pa.array(digests(text), pa.binary())


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_sha256, keep_id, group_size, kept."""
    small_batches(docs.sparkSession)
    hashed = docs.select("doc_id", text_sha("text").alias("sha"))
    marked = materialise(tested(hashed, "sha", "maybe", hits=2), "dedup-tested")
    alone = marked.where("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # equal rows first become one counted row, so a repeated doc_id is one row from here on
    counted = marked.where("maybe").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = materialise(counted.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "dedup-groups")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    rows = counted.join(groups, "sha").select("doc_id", "sha", "keep_id", "group_size", copy)
    grouped = rows.select("doc_id", "sha", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    small_batches(docs.sparkSession)
    looked, kept = fresh(docs, "looked", "kept_row")
    hashed = materialise(docs.select(text_sha("text").alias("sha")), "dedup-hashed")
    counted = tested(hashed, "sha", "maybe", hits=2).where("maybe").groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialise(counted.where("n > 1").select("sha"), "dedup-repeated")
    maybe = membership(repeated, "sha")

    @F.arrow_udf("struct<sha binary, maybe boolean>")
    def look(text: pa.Array) -> pa.Array:
        found = digests(text)
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(maybe(found))], ["sha", "maybe"])

    # the filter would be moved below a repeatable step, which then ran twice in one stage
    marked = docs.withColumn(looked, look.asNondeterministic()("text"))
    suspects = marked.where(F.col(looked)["maybe"])
    # null ids are the smallest; a task sends one row of a text at most
    largest = F.max_by(F.struct(*docs.columns), F.struct("doc_id")).alias(kept)
    chosen = suspects.groupBy(F.col(looked)["sha"]).agg(largest).select(*[F.col(kept)[c].alias(c) for c in docs.columns])
    return marked.where(~F.col(looked)["maybe"]).select(*docs.columns).unionByName(chosen)
