import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import empty, frame, rows
from tokenloom.llm import bytebpe, common, packing, tokenfiles, wordcodec

WORD = Tokenizer.from_file(P.path("word_bpe_49k.json"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
BYTE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1d\x85  　aAbB'’sdé́Σσς½9.!<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


def word_ids(text):
    return WORD.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_word_codec_equals_the_library(texts):
    ids, lens = wordcodec.codec(wordcodec.tokenizer_file()).encode([t.encode() for t in texts])
    cuts = common.bounds(lens).tolist()
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [word_ids(t) for t in texts]


def test_word_codec_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(wordcodec, "CACHE_WORDS", 5)
    coder = wordcodec.WordCodec(wordcodec.tokenizer_file())
    texts = [f"one{i} two{i} three{i}" for i in range(20)]
    for t in texts:
        assert coder.encode([t.encode()])[0].tolist() == word_ids(t)
        assert len(coder.index) <= 6
    assert coder.encode([b"one1 two1 one1 ABC, \xc3\x89t\xc3\xa9. <|endoftext|> <|END|>"])[0].tolist() == word_ids("one1 two1 one1 ABC, Été. <|endoftext|> <|END|>")


def test_words_with_marks_are_kept_once():
    coder = wordcodec.WordCodec(wordcodec.tokenizer_file())
    marks = [".", ",", "!?", "...", "-", "<|"]
    texts = [f"{w}{m} {m} {w}" for w in ("alpha", "Été", "beta", "x") for m in marks]
    ids, lens = coder.encode([t.encode() for t in texts])
    cuts = common.bounds(lens).tolist()
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [word_ids(t) for t in texts]
    assert len(coder.index) == 4 + len(marks) + len(marks)  # letters, marks behind them, words of marks


def test_word_codec_with_equal_hashes(monkeypatch):
    real = wordcodec.word_hashes
    monkeypatch.setattr(wordcodec, "word_hashes", lambda low, starts, ends, *base: real(low, starts, ends, *base) if base else np.zeros(len(starts), np.uint64))
    texts = ["one, two. Two one! , .", "", "né, a1 a1, NÉ ."]
    ids, lens = wordcodec.WordCodec(wordcodec.tokenizer_file()).encode([t.encode() for t in texts])
    cuts = common.bounds(lens).tolist()
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [word_ids(t) for t in texts]


@settings(max_examples=600, deadline=None)
@given(TEXT)
def test_cutter_equals_the_pattern(text):
    cutter = bytebpe.Cutter(bytebpe.word_pattern())
    numbers = cutter.piece_numbers(text)
    vocabulary, flat, lens = cutter.piece_words()
    names, cuts = list(vocabulary), common.bounds(lens)
    found = [names[w] for n in numbers for w in flat[cuts[n] : cuts[n + 1]]]
    assert "".join(found) == text
    assert [i for w in found for i in BYTE._encode_single_piece(w.encode())] == BYTE.encode_ordinary(text)


def test_byte_bpe_equals_the_library(spark):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trip(frame(spark)).collect())
    want = []
    for r in rows():
        ids, text = BYTE.encode_ordinary(r[1] or ""), (r[1] or "").encode()
        want.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert got == sorted(want)


def test_byte_bpe_in_small_chunks(spark, monkeypatch):
    docs = frame(spark).repartition(3)
    monkeypatch.setattr(bytebpe, "CHUNK_BYTES", 500)
    got = sorted((str(r.doc_id), r.ids) for r in bytebpe.encode(docs).collect())
    assert got == sorted((str(r[0]), BYTE.encode_ordinary(r[1] or "")) for r in rows())


def test_varint_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**34], np.int64)
    assert common.unvarint(common.varint(values)).tolist() == values.tolist()
    assert common.unvarint(common.varint(values[:0])).tolist() == []


def test_token_files(spark):
    got = tokenfiles.token_digest(spark, frame(spark)).orderBy("start").collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    start = 0
    by_doc = {}
    for r in want:
        by_doc.setdefault(r[0], []).append(word_ids(r[1]) + [1])
    for r in got:
        assert r.start == start
        start += r.n_tokens
        crcs = [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in by_doc[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in crcs


def test_token_file_lookup_prunes(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfiles.write_token_files(frame(spark), path)
    found = tokenfiles.read_token_files(spark, path, [7, 14, 10**9])
    assert sorted(r.doc_id for r in found.collect()) == [7, 14]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()
    manifest = spark.read.orc(f"{path}/manifest").orderBy("part").collect()
    assert [m.start for m in manifest] == [sum(x.tokens for x in manifest[:i]) for i in range(len(manifest))]


def brute_best_fit(lengths, size):
    open_ = []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in open_ if c >= n]
        if fit:
            open_.remove(min(fit))
            open_.append(min(fit) - n)
        else:
            open_.append(size - n)
    return sorted(open_)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    steps, fills = packing.plan({n: lengths.count(n) for n in set(lengths)}, 32)
    left = sorted(32 - int(t) for a, b, t in fills.tolist() for _ in range(b - a))
    assert left == brute_best_fit(lengths, 32)
    used = {}
    for n, a, b, first, each, offset in steps.tolist():
        for r in range(a, b):
            used.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * n, n))
    for pieces in used.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 32
    assert sum(map(len, used.values())) == len(lengths)


def test_capacity_tree():
    tree = packing.CapacityTree(100)
    assert tree.tightest(1) is None
    for c in (7, 40, 100):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (1, 7, 8, 40, 41, 100)] == [7, 7, 40, 40, 100, 100]
    tree.add(40, -1)
    assert tree.tightest(8) == 100


def check_pieces(got, want_docs):
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 4096 and {r.sequence_tokens for r in own} == {end}
        assert {r.padded for r in own} == {end if end & (end - 1) == 0 else 4096}
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(len(i) for i in want_docs)
    assert sum(r.length for r in got) == total


def test_packing(spark):
    got = packing.pack(frame(spark).repartition(4)).collect()
    want = [(r[0], word_ids(r[1]) + [2]) for r in rows()]
    check_pieces(got, [i for _, i in want])
    pieces = []
    for doc, ids in want:
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            pieces.append((str(doc), a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(pieces)


def test_packed_sequences_hold_the_ids(spark):
    out = packing.sequences(frame(spark)).collect()
    assert all(0 < len(r.ids) <= 4096 for r in out)
    assert sum(len(r.ids) for r in out) == sum(len(word_ids(r[1])) + 1 for r in rows())


def test_empty_tables(spark):
    assert packing.pack(empty(spark)).collect() == []
    assert bytebpe.round_trip(empty(spark)).collect() == []
    assert tokenfiles.token_digest(spark, empty(spark)).collect() == []
