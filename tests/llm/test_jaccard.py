import random
import re

import numpy as np

from tests.llm.data import empty, frame, rows, words
from tokenloom.llm import jaccard


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def alike(a, b):
    return a == b or (len(a | b) > 0 and len(a & b) / len(a | b) >= 0.8)


def brute(table):
    """(n_links per row, class of each row)"""
    sets = [grams(t) for _, t in table]
    links = [sum(j != i and alike(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(top(i), []).append(i)
    names = {}
    for own in groups.values():
        ids = [table[i][0] for i in own if table[i][0] is not None]
        for i in own:
            names[i] = min(ids) if ids else None
    return sorted((str(table[i][0]), str(names[i]), links[i]) for i in range(len(table)))


def near_copies(n, seed=1):
    rng = random.Random(seed)
    out = []
    for g in range(8):
        base = words(rng, 150).split()
        for _ in range(n if g == 0 else 4):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(10**6))
            out.append(" ".join(copy))
    return list(enumerate(out))


def got(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def test_awkward_rows(spark):
    assert got(jaccard.near_classes(frame(spark))) == brute([(r[0], r[1]) for r in rows()])


def test_near_copies_in_blocks(spark, monkeypatch):
    table = near_copies(60)
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert got(jaccard.near_classes(df)) == brute(table)
    monkeypatch.setattr(jaccard.bucket_tasks, "__defaults__", (7,))
    assert got(jaccard.near_classes(df)) == brute(table)


def test_one_document_of_each_class_stays(spark):
    docs = frame(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    sets = {grams(r[1]) for r in rows()}
    for i, a in enumerate(out):
        assert not any(alike(grams(a.text), grams(b.text)) for b in out[:i])
    assert all(any(alike(s, grams(r.text)) for r in out) for s in sets)


def test_components(spark):
    pairs = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)] + [(b"900", b"950"), (b"950", b"920"), (b"777", b"777")]
    out = {bytes(r.node): bytes(r.component) for r in jaccard.components(spark.createDataFrame(pairs, "u binary, v binary")).collect()}
    assert {out[b"%03d" % i] for i in range(41)} == {b"000"}
    assert {out[x] for x in (b"900", b"920", b"950")} == {b"900"}


def test_shape_reaches_recall():
    bands, n = jaccard.band_shape()
    assert bands * n <= jaccard.HASHES and 1 - (1 - 0.8**n) ** bands >= jaccard.RECALL


def test_shingles_of_short_texts():
    sets = list(jaccard.Shingler().sets([b"", b"one", b"ONE!", b"a b c d", b"a b c d e", b"a b c d e f"]))
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 2]
    assert np.array_equal(sets[1], sets[2])


def test_empty_table(spark):
    assert jaccard.near_classes(empty(spark)).collect() == []
    assert jaccard.keep_one(empty(spark)).collect() == []
