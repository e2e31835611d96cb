import zlib
from collections import Counter

from tests.llm.data import empty, frame, rows
from tokenloom.llm import sharding


def test_documents_are_placed(spark):
    got = sharding.shard_documents(frame(spark)).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None for r in got)
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_sizes_are_near_equal(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(pmod(xxhash64(id), 900) as int)) as text")
    sizes = Counter()
    for r in sharding.shard_documents(docs).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) < 1.01 * min(sizes.values())


def test_a_repeated_row_is_spread(spark):
    docs = spark.range(5000).selectExpr("cast(7 as long) as doc_id", "'same text' as text")
    rows_ = Counter(r.shard for r in sharding.shard_documents(docs).collect())
    assert len(rows_) == 16 and max(rows_.values()) < 1.2 * min(rows_.values())


def test_growing_moves_slots_to_the_new_shard_only(spark, tmp_path):
    totals = [(s, 100 + s * 37 % 91 if s % 7 else 0, 2) for s in range(4096)]
    old = sharding.balanced(totals, 16)
    new = sharding.grown(totals, old, 16)
    assert all(new[s] in (old[s], 16) for s in old)
    size = Counter()
    for s, b, _ in totals:
        size[new[s]] += b
    assert len(size) == 17 and max(size.values()) < 1.05 * min(size.values())
    sharding.save_map(spark, str(tmp_path), 1, totals, old)
    sharding.save_map(spark, str(tmp_path), 2, totals, new)
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path), 1).collect()} == old
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path), 2).collect()} == new


def test_a_stored_map_places_documents_it_has_never_seen(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(pmod(xxhash64(id), 900) as int)) as text")
    first = docs.where("doc_id < 500")
    assert len(sharding.shard_documents(first, map_path=path).collect()) == 500
    placed = sharding.assign(sharding.records(docs), sharding.load_map(spark, path, 1)).collect()
    assert sorted(r.doc_id for r in placed) == list(range(1000))
    for shard in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))
    known = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    assert len(known) == sharding.SLOTS and all(known[r.virtual_slot] == r.shard for r in placed)


def test_rebalancing_stores_the_next_version(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', if(id < 600, 100, cast(pmod(xxhash64(id), 3000) as int))) as text")
    sharding.shard_documents(docs.where("doc_id < 600"), map_path=path).count()
    moved = sharding.rebalance(spark, docs, path, 1).collect()
    one, two = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    assert {(r.virtual_slot, r.old_shard, r.shard) for r in moved} == {(s, one[s], two[s]) for s in one if one[s] != two[s]} != set()

    def sizes(version):
        out = Counter()
        for r in sharding.assign(sharding.records(docs), sharding.load_map(spark, path, version)).collect():
            out[r.shard] += r.size
        return out

    before, after = sizes(1), sizes(2)
    assert max(after.values()) < 1.02 * sum(after.values()) / 16 < max(before.values()) and len(moved) < sharding.SLOTS / 4
    grown = sharding.rebalance(spark, docs, path, 2, add_shard=True).collect()
    assert grown and all(r.shard == 16 for r in grown)
    final = sizes(3)
    assert len(final) == 17 and max(final.values()) < 1.05 * sum(final.values()) / 17
