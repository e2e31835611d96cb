import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import data
from tokenloom.llm import bytewords, collocations


def by_hand(rows, longest=3, least=10, top=2000, share=50):
    """Counts every n-gram of every piece; no chunks, no hashes."""
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = tuple(w.decode() for w in re.findall(rb"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    phrases = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in phrases.items():
        for m in range(2, len(w)):
            for p in range(len(w) - m + 1):
                key = lang, w[p : p + m]
                inside[key] = max(inside.get(key, 0), a)
    found = {}
    for (lang, w), a in phrases.items():
        if 100 * inside.get((lang, w), 0) >= share * a and (lang, w) in inside:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((int(Fraction(10**6 * a * a, left * right)), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, items in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(items)[:top], 1)
    }


def result(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def corpus():
    rows = data.rows()
    text = "The  cat\tsat on the mat. The cat sat, the cat; ÉTÉ été\x0bthe cat sat"
    hot = [(100 + i, text, ("en", None, "und", "")[i % 4], "s", 1, "k", 1, "r") for i in range(60)]
    return rows + hot + [(200, "same " * 9000, "en", None, None, None, None, None)]


def test_equals_counting_by_hand(spark):
    got = result(collocations.collocations(data.frame(spark, corpus()).repartition(5)))
    assert got == by_hand(corpus())
    assert {r[0] for r in got} >= {"en", "und", ""}


@pytest.mark.parametrize("longest, least, top, share", [(2, 3, 4, 50), (4, 5, 2000, 30), (3, 1, 40, 100)])
def test_other_parameters(spark, longest, least, top, share):
    got = collocations.collocations(data.frame(spark, corpus()), longest, least, top, share)
    assert result(got) == by_hand(corpus(), longest, least, top, share)


def test_rounds_of_hash_ranges_and_long_texts_in_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_BITS", 64 * 24)
    want = by_hand(corpus())
    assert result(collocations.collocations(data.frame(spark, corpus()))) == want
    text = "one two three four. " * 400
    assert b"".join(collocations._parts(text.encode())) == text.encode()
    monkeypatch.setattr(collocations, "LONG", 1000)
    parts = list(collocations._parts(text.encode()))
    assert len(parts) > 7 and all(p.endswith(b".") for p in parts[:-1]) and b"".join(parts) == text.encode()


def test_no_documents_no_phrases(spark):
    assert result(collocations.collocations(data.empty(spark))) == set()


def test_chunks_hold_every_ngram_once_and_repeat_with_the_content():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 300, 6000)]
    passage = " ".join(words[:2000])
    batch = collocations.parse(pa.array(["en"] * 2), pa.array([passage, f"other words {passage} and the end"]), 3)
    chunks = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
    seen = Counter()
    for chunk, own in chunks:
        body = re.findall(r"[^ \r\n]+", chunk)
        seen.update(tuple(body[i : i + 3]) for i in range(own) if i + 3 <= len(body))
    assert seen == Counter(tuple(t[i : i + 3]) for t in (passage.split(), f"other words {passage} and the end".split()) for i in range(len(t) - 2))
    assert len(set(chunks)) < 0.6 * len(chunks)  # the second copy of the passage adds few chunks


def test_words_hash_alike_wherever_they_stand():
    texts = pa.array(["", "a b", "x" * 50, "a", "éa b a"])
    buf, cuts = bytewords.flat(texts.slice(1))
    assert cuts.tolist() == [0, 3, 53, 54, 61]
    starts, ends = bytewords.runs_of(buf != 32)
    starts, ends = np.array([0, 2, 3, 53, 60]), np.array([1, 3, 53, 54, 61])
    a, b, _, a2, a3 = bytewords.word_hashes(buf, starts, ends)
    assert a == a2 == a3 != b


def test_hash_tables_are_as_long_as_a_step(monkeypatch):
    monkeypatch.setattr(bytewords, "_POWERS", {})
    buf = np.frombuffer((b"some words " * 200_000), np.uint8)
    starts, ends = bytewords.runs_of(buf != 32)
    assert len(set(bytewords.word_hashes(buf, starts, ends).tolist())) == 2
    assert bytewords._POWERS[bytewords.BASE].shape[1] <= 1 << 16
    long = np.frombuffer(b"a " + b"xy" * 50_000 + b" a " + b"xy" * 50_000, np.uint8)  # longer than a step
    a, x, a2, x2 = bytewords.word_hashes(long, *bytewords.runs_of(long != 32))
    assert a == a2 != x == x2


def test_hashes_do_not_depend_on_windows(monkeypatch):
    rng = np.random.default_rng(1)
    buf = rng.choice(np.frombuffer(b"abc  ", np.uint8), 5000)
    starts, ends = bytewords.runs_of(buf != 32)
    want = {}
    for s, e, h in zip(starts, ends, bytewords.word_hashes(buf, starts, ends)):
        assert want.setdefault(buf[s:e].tobytes(), h) == h
    monkeypatch.setattr(bytewords, "WINDOW", 64)
    assert (bytewords.word_hashes(buf, starts, ends) == [want[buf[s:e].tobytes()] for s, e in zip(starts, ends)]).all()
    assert len(set(want.values())) == len(want)
