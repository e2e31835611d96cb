"""Words of UTF-8 text as byte ranges with 64-bit hashes, a whole batch at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

WINDOW, STEP = 1 << 20, 1 << 16  # longest word by a polynomial; bytes at a time
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd
_POWERS: dict[int, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the cuts between its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or _POWERS[base].shape[1] < n:
        steps = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64).repeat(n, axis=1)
        steps[:, 0] = 1
        _POWERS[base] = np.cumprod(steps, axis=1)
    return _POWERS[base]


def _windows(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + min(STEP, WINDOW), side="right")))
        yield a, b
        a = b


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of each byte range (ascending, disjoint): a polynomial by prefix sums, words over ``WINDOW`` by digest."""
    out = np.zeros(len(starts), np.uint64)
    for a, b in _windows(starts, ends):
        lo, hi = int(starts[a]), int(ends[b - 1])
        if hi - lo > WINDOW:
            out[a] = int.from_bytes(blake2b(buf[lo:hi].tobytes(), digest_size=8).digest(), "little")
            continue
        power, inverse = _powers(base, max(min(STEP, WINDOW), hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s = starts[a:b] - lo
        out[a:b] = (sums[ends[a:b] - lo] - sums[s]) * inverse[s]
    return mix(out)
