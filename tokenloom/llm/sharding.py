"""Sharding (4): fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` virtual slots, far more than shards. Bytes
and rows are added up per slot (map-side combined, so a hot slot is one sum),
and the map gives whole slots, heaviest first, to the lightest shard. The map
has ``SLOTS`` rows whatever the corpus, one for every slot that a record can
have, so it can be planned in one place and broadcast, and a stored map places
records it has never seen. It is stored as a table with a version; ``rebalance``
loads a version, edits it for the documents there are now and stores the next:
slots leave the heaviest shards, or move to a new shard only.

Defined cases: null text has no bytes (size 1, CRC-32 of nothing is 0); null
doc_ids hash like a value; equal rows are told apart by a copy number, so a
row repeated many times is spread too; an empty table gives no rows. A single
document is never split.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes bigint, rows bigint"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy and virtual_slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return each.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int"))


Totals = list[tuple[int, int, int]]


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> Totals:
    """(virtual slot, bytes, rows) of every slot, also of those without records."""
    found = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    return [(slot, *found.get(slot, (0, 0))) for slot in range(slots)]


def balanced(totals: Totals, shards: int) -> dict[int, int]:
    """Slot to shard, heaviest slot first to the lightest shard; empty slots are dealt in turn."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(totals, key=lambda t: (-t[1], t[0])):
        if not size:
            out[slot] = slot % shards
            continue
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _loads(totals: Totals, shard_of: dict[int, int], shards: int) -> tuple[dict[int, int], list[int], dict[int, list[int]]]:
    """Bytes of each slot and shard, and the slots of each shard, the lightest last."""
    sizes = {slot: size for slot, size, _ in totals}
    load, owned = [0] * shards, {s: [] for s in range(shards)}
    for slot, shard in shard_of.items():
        load[shard] += sizes.get(slot, 0)
        owned[shard].append(slot)
    for slots in owned.values():
        slots.sort(key=lambda s: (-sizes.get(s, 0), s))
    return sizes, load, owned


def grown(totals: Totals, shard_of: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for one more shard: slots leave the heaviest shards for the new one only."""
    sizes, load, owned = _loads(totals, shard_of, shards + 1)
    out, goal = dict(shard_of), sum(load) / (shards + 1)
    while True:
        donor = max(range(shards), key=lambda s: (load[s], -s))
        if not owned[donor] or load[donor] <= goal:
            return out
        slot = owned[donor].pop()
        size = sizes.get(slot, 0)
        if load[shards] + size > goal:
            return out
        out[slot] = shards
        load[donor] -= size
        load[shards] += size


def evened(totals: Totals, shard_of: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The map edited by few moves: the heaviest shard gives the lightest its largest slot that narrows their distance."""
    sizes, load, owned = _loads(totals, shard_of, shards)
    out, mean = dict(shard_of), sum(load) / shards
    for _ in range(len(shard_of)):
        donor, taker = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        if load[donor] <= (1 + tolerance) * mean:
            break
        room = min(load[donor] - mean, (load[donor] - load[taker]) / 2)
        slot = next((s for s in owned[donor] if 0 < sizes.get(s, 0) <= room), None)
        if slot is None:
            break
        owned[donor].remove(slot)
        owned[taker].append(slot)
        owned[taker].sort(key=lambda s: (-sizes.get(s, 0), s))
        out[slot] = taker
        load[donor] -= sizes[slot]
        load[taker] += sizes[slot]
    return out


def save_map(spark: SparkSession, path: str, version: int, totals: Totals, shard_of: dict[int, int]) -> DataFrame:
    """Store one version of the map, with the bytes and rows each slot had."""
    rows = [(version, slot, shard_of[slot], size, n) for slot, size, n in totals]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/v{version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version}")


def rebalance(spark: SparkSession, docs: DataFrame, path: str, version: int, add_shard: bool = False, tolerance: float = 0.01) -> DataFrame:
    """Load a version, edit it for ``docs``, store it as the next one; the moved slots (virtual_slot, old_shard, shard)."""
    old = {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, version).collect()}  # SLOTS rows
    totals, shards = slot_totals(records(docs)), max(old.values()) + 1
    new = grown(totals, old, shards) if add_shard else evened(totals, old, shards, tolerance)
    save_map(spark, path, version + 1, totals, new)
    return spark.createDataFrame([(s, old[s], new[s]) for s in sorted(old) if old[s] != new[s]], "virtual_slot int, old_shard int, shard int")


def assign(rows: DataFrame, slot_map: DataFrame, totals: Totals | None = None) -> DataFrame:
    """shard and slot (place in the shard, gapless from 0) of every record.

    Where a slot begins in its shard follows from the records placed now
    (``totals`` if they are counted already), not from those of the map.
    """
    counts = rows.sparkSession.createDataFrame([(s, n) for s, _, n in (totals or slot_totals(rows))], "virtual_slot int, _n bigint")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slot_map.select("virtual_slot", "shard").join(counts, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return rows.withColumn("place", place).join(F.broadcast(begins), "virtual_slot").withColumn("slot", F.col("first") + F.col("place") - 1)  # at most SLOTS rows


def shard_documents(docs: DataFrame, shards: int = 16, map_path: str | None = None) -> DataFrame:
    """Every document with its shard under version 1 of a fresh map."""
    spark = docs.sparkSession
    rows, path = records(docs), map_path or scratch_path(spark, "slot-map")
    totals = slot_totals(rows)
    slot_map = save_map(spark, path, 1, totals, balanced(totals, shards))
    return assign(rows, slot_map, totals).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
