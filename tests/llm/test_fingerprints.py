import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm import data
from tokenloom.llm import fingerprints


def shingle_set(text):
    words = re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", text.encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def order(row):
    return row[0] is not None, row[0] or 0, row[1]


def by_hand(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=order)
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), similarity(text, edited), similarity(text, after), text))
    return out


def compare(spark, rows, parts):
    got = fingerprints.neighbours(data.frame(spark, rows).repartition(parts)).collect()
    want = by_hand(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], round(r[3], 9))
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.jaccard_edited, r.near_edited, r.near_next, r.fingerprint, r.edited_fingerprint, r.bands_edited) for r in got), key=key)
    want.sort(key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    fingerprint = {}
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3])
        assert abs(g[4] - w[3]) < 0.2 and abs(g[5] - w[4]) < 0.2
        assert fingerprint.setdefault(w[5], g[6]) == g[6]
        assert len(g[6]) == len(g[7]) == 4 * fingerprints.HASHES
        assert (g[6] == g[7]) == (g[4] == 1.0) and (g[8] == fingerprints.BANDS) == (g[4] == 1.0)
    return got


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_neighbours_equal_those_by_hand(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        compare(spark, data.rows(), 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_likeness_of_many_documents_is_close_to_the_similarity(spark):
    rng = random.Random(2)
    rows = [(7 * i, data.words(rng, rng.choice([3, 50, 400])), "en", "s", 1, "k", 1, "r") for i in range(300)]
    got = compare(spark, rows, 9)
    off = [g[4] - w[3] for g, w in zip(got, sorted(by_hand(rows), key=lambda r: r[0]))]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06


def test_a_single_row_follows_itself_and_no_rows_give_none(spark):
    row = (5, "one two three four five six seven eight", None, None, None, None, None, None)
    got = compare(spark, [row], 2)
    assert len(got) == 1 and got[0][5] == 1.0
    assert fingerprints.neighbours(data.empty(spark)).collect() == []


def test_rows_of_one_doc_id_and_batches_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "STEP", 1)
    rows = [(1, f"text {i % 7} " + "of some words " * (i % 5), "en", "s", 1, "k", 1, "r") for i in range(60)]
    compare(spark, rows + data.rows()[:12], 4)


def test_signature_is_the_smallest_value_of_each_function():
    texts = [b"a b c d e f g", b"", b"x y", b"A B c d e f g h"]
    values, lens = fingerprints.shingles(texts)
    assert lens.tolist() == [3, 0, 1, 4] and values[:3].tolist() == values[4:7].tolist()
    signed = fingerprints.signatures(values, lens)
    mask = (1 << 64) - 1
    for row, part in zip(signed, np.split(values, np.cumsum(lens)[:-1])):
        for low, (mul, add) in zip(row, fingerprints._functions()):
            assert int(low) == min(((int(v) >> 32) * int(mul) + int(add) & mask) >> 32 for v in part) if len(part) else int(low) == 0xFFFFFFFF
    assert fingerprints.likeness(signed[:1], signed[3:])[0] == pytest.approx(0.75, abs=0.15)


def test_representatives_are_verified_and_shared_by_copies(spark):
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(12):
        base = data.words(rng, 200).split()
        for j in range(8):
            words = list(base)
            if j > 3:
                words[rng.randrange(200)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words), "en", "s", 1, "k", 1, "r"))
    rows += [(900, None, *[None] * 6), (901, "  ", *[None] * 6), (None, "only here once, with words", *[None] * 6)]
    got = {r.doc_id: (r.representative, r.similarity) for r in fingerprints.representatives(data.frame(spark, rows).repartition(6)).collect()}
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for doc, (rep, sim) in got.items():
        if doc in group:
            assert group[rep] == group[doc] and sim == pytest.approx(similarity(text[doc], text[rep])) and sim >= 0.8
    assert len({got[d][0] for d in group}) <= 24  # 12 groups, few fingerprints that lead
    assert got[900] == got[901] == (900, 1.0) and got[None] == (None, 1.0)
    assert fingerprints.representatives(data.empty(spark)).collect() == []
