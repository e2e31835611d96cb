import hashlib
from collections import defaultdict

import pytest

from tests.llm.data import empty, frame, rows
from tokenloom.llm import bloom, dedup


def norm(text):
    return (text or "").encode().lower()


def test_groups_match_brute_force(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    got = dedup.duplicate_groups(frame(spark)).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for text, ids in groups.items():
        own = by[hashlib.sha256(text).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        assert {r.keep_id for r in own} == {max(known) if known else None}
        assert {r.group_size for r in own} == {len(ids)}
        assert sum(r.kept for r in own) == 1


def test_kept_rows_have_all_columns(spark):
    docs = frame(spark)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(norm(r.text) for r in out) == sorted({norm(r[1]) for r in rows()})


def test_empty_table(spark):
    assert dedup.duplicate_groups(empty(spark)).collect() == []
    assert dedup.drop_copies(empty(spark)).collect() == []


@pytest.mark.parametrize("hits", [1, 2])
def test_filter_never_misses(spark, hits):
    keys = [(hashlib.sha256(str(i % 700).encode()).digest(),) for i in range(1000)]
    df = spark.createDataFrame(keys, "k binary")
    test = bloom.bloom(df, "k", hits)
    others = [(hashlib.sha256(f"x{i}".encode()).digest(),) for i in range(1000)]
    inside = {bytes(r.k) for r in df.where(test("k")).collect()}
    repeated = {k for k, in keys if hits == 1 or keys.count((k,)) > 1}
    assert repeated <= inside
    assert spark.createDataFrame(others, "k binary").where(test("k")).count() < 40
    if hits == 2:
        assert len(inside) < 360  # few unique rows pass


def test_filter_full_of_bits_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MIN_BITS", 1 << 9)
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 9)
    kept = dedup.drop_copies(frame(spark)).collect()
    assert sorted(norm(r.text) for r in kept) == sorted({norm(r[1]) for r in rows()})


@pytest.mark.parametrize("most", [1 << 30, 1 << 12])
def test_unique_rows_pass_straight_through_at_every_size(spark, monkeypatch, most):
    """Far more rows than a table has bits for: rounds of hash ranges let as few unique rows through as one table."""
    monkeypatch.setattr(bloom, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(bloom, "MAX_BITS", most)
    keys = [hashlib.sha256(str(i if i < 4000 else i % 50).encode()).digest() for i in range(4400)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, k binary")
    assert (bloom.rounds_for(4400) > 10) == (most == 1 << 12)
    got = bloom.tested(df, "k", "maybe", hits=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(4400))
    assert all(r.maybe for r in got if r.doc_id < 50 or r.doc_id >= 4000)
    assert sum(r.maybe for r in got if 50 <= r.doc_id < 4000) < 0.03 * 3950


def test_only_suspects_are_shuffled(spark):
    plan = dedup.duplicate_groups(frame(spark))._jdf.queryExecution().executedPlan().toString()
    straight = plan.split("Union", 1)[1]
    assert straight.index("Filter") < straight.index("Exchange") if "Exchange" in straight else True
