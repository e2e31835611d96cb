"""Encoding of whole texts with a vocabulary file of the tokenizers library.

The vocabulary of word ends drops white space, ignores case and never joins two
words, so a text has the ids of its white-space separated words in order. Words
are told apart by two 64-bit hashes, taken in numpy for a whole step; each
distinct word is encoded once and kept in a bounded cache of the worker, which
forgets the words it met only once when it is full. Latin letters with marks
behind them are two entries of the library's BPE model, so such words are cut
before they are told apart: letters and marks are units of their own, and a
known word with another mark is not a new one. Every other word is one unit and
goes through the library's whole pipeline.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Sequence
from itertools import chain, repeat

import numpy as np

from .bytewords import OTHER_BASE, runs_of, word_hashes
from .common import bounds, slices, take_ranges

WORD_FILE = "word_bpe_49k.json"
STEP_BYTES = 1 << 20
CACHE_WORDS, CACHE_BYTES = 250_000, 16 << 20
OTHER, LETTERS, MARKS = 0, 1, 2
_MARKED = np.uint64(0x9FB21C651E98DF25)
_MARKS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False  # the signs of multiplication and division
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_LOWER = np.arange(256, dtype=np.uint8)  # A-Z in lower case, as the vocabulary has it
_LOWER[65:91] += 32
# bytes as the printable characters that byte-level vocabularies use: printable bytes stay, the others follow 255
_STAY = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _STAY]
_CHARS = "".join(chr(256 + _OTHERS.index(b) if b in _OTHERS else b) for b in range(256))


def tokenizer_file(path: str | None = None, name: str = WORD_FILE) -> bytes:
    """Content of a vocabulary file (fixed size); it travels to the workers with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


class WordCodec:
    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.starts, self.lens, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words met twice or more, if they are short and at most half a cache."""
        keep = [w for w, n in zip(self.index, self.hits.tolist()) if n > 1 and len(w) < 64]
        if len(keep) > CACHE_WORDS // 2:
            keep = []
        at = np.fromiter(map(self.index.__getitem__, keep), np.int64, len(keep))
        flat, lens = take_ranges(self.flat, self.starts[at], self.lens[at]), self.lens[at]
        self._clear()
        self._add(keep, flat, lens)

    def _add(self, words: Sequence[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.flat) + bounds(lens)[:-1]))
        self.lens = np.concatenate((self.lens, lens))
        self.flat = np.concatenate((self.flat, flat))
        self.hits = np.concatenate((self.hits, np.zeros(len(words), np.int32)))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))

    def _ids(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens

    def _model(self, keys: list[bytes], pieces: list[bytes]) -> None:
        """Learn pieces (words of letters, or runs of marks) that are single entries of the model."""
        if keys:
            tokenize, text = self.tokenizer.model.tokenize, b"\n".join(pieces).decode().lower().encode()
            texts = codecs.charmap_decode(text, "strict", _CHARS)[0].split(_CHARS[10])
            self._add(keys, *self._ids([[t.id for t in tokenize(x)] for x in texts]))

    def _learn(self, units: list[bytes], kinds: np.ndarray) -> None:
        letters, marks, other = ([units[i] for i in np.flatnonzero(kinds == k).tolist()] for k in (LETTERS, MARKS, OTHER))
        self._model(letters, letters)
        self._model(marks, [m[1:] for m in marks])
        if other:
            self._add(other, *self._ids([e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]))

    def _distinct(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct units of some texts, their kinds, which of them each unit is, and how many units each text has."""
        joined = b"\n".join(texts) + b"\n"
        raw, cuts = np.frombuffer(joined, np.uint8), bounds(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        low = _LOWER[raw]
        if b"<|" in joined:  # special tokens are written in lower case, so texts with their brackets keep their case
            for i, text in enumerate(texts):
                if b"<|" in text:
                    low[cuts[i] : cuts[i + 1]] = raw[cuts[i] : cuts[i + 1]]
        starts, ends, kinds = _units(low)
        many = np.diff(np.searchsorted(starts, cuts))
        marks = np.where(kinds == MARKS, _MARKED, np.uint64(0))  # other hashes than those of words of marks alone
        _, first, which = np.unique(word_hashes(low, starts, ends) ^ marks, return_index=True, return_inverse=True)
        data = low.tobytes()
        other = word_hashes(low, starts, ends, OTHER_BASE) ^ marks
        if not (other == other[first][which]).all():  # two units with one hash: take them by their bytes
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(u, len(index)) for u in _named(data, starts, ends, kinds)], np.int64)
            first = np.unique(which, return_index=True)[1]
        return _named(data, starts[first], ends[first], kinds[first]), kinds[first], which, many

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        flats, lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in slices(map(len, texts), STEP_BYTES):
            units, kinds, which, many = self._distinct(texts[a:b])
            codes = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
            missed = np.flatnonzero(codes < 0)
            if len(missed):
                new = list(map(units.__getitem__, missed.tolist()))
                if len(self.index) + len(new) > CACHE_WORDS or sum(map(len, new)) > CACHE_BYTES:
                    self._forget()
                    codes = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
                    missed = np.flatnonzero(codes < 0)
                    new = list(map(units.__getitem__, missed.tolist()))
                self._learn(new, kinds[missed])
                codes[missed] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
            self.hits[codes] += np.bincount(which, minlength=len(units)).astype(np.int32)
            codes = codes[which]
            each = self.lens[codes]
            flats.append(take_ranges(self.flat, self.starts[codes], each))
            lens.append(np.diff(bounds(each)[bounds(many)]))
        return np.concatenate(flats), np.concatenate(lens)


def _units(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind of every unit; white space follows the last one."""
    inside, mark, letter = ~_BLANK[low], _IS_MARK[low], (low >= 97) & (low <= 122)
    lead = np.flatnonzero(low[:-1] == 0xC3)
    lead = lead[_AFTER_C3[low[lead + 1]]]  # the letters of U+00C0 to U+00FF have two bytes
    letter[lead] = letter[lead + 1] = True
    starts, ends = runs_of(inside)
    odd = inside & ~letter & ~mark
    odd[1:] |= letter[1:] & mark[:-1]
    whole = np.zeros(len(starts), bool)  # words that are no letters with marks behind them
    whole[np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1] = True
    cut = np.flatnonzero(mark[1:] & letter[:-1]) + 1
    owner = np.searchsorted(starts, cut, side="right") - 1
    cut, owner = cut[~whole[owner]], owner[~whole[owner]]
    kinds = np.where(letter[starts] & ~whole, LETTERS, OTHER)
    return np.insert(starts, owner + 1, cut), np.insert(ends, owner, cut), np.insert(kinds, owner + 1, MARKS)


def _named(data: bytes, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> list[bytes]:
    """The bytes of units; marks cut off have a space in front, which no word holds."""
    out = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    for i in np.flatnonzero(kinds == MARKS).tolist():
        out[i] = b" " + out[i]
    return out


_CODECS: dict[bytes, WordCodec] = {}


def codec(content: bytes) -> WordCodec:
    """The worker's codec; its cache lives on in later tasks of the worker."""
    if content not in _CODECS:
        _CODECS.clear()
        _CODECS[content] = WordCodec(content)
    return _CODECS[content]


def release() -> None:
    """Drop the worker's codec, so that later stages find its memory free."""
    _CODECS.clear()


def with_end(flat: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same lists, each closed with the id ``end``."""
    return np.insert(flat, np.cumsum(lens), end).astype(np.int32), lens + 1
