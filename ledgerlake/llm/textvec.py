"""Words of many texts at once, as numpy arrays.

A word is a run of bytes that aren't ASCII white space (0x20, 0x09-0x0D). Each word gets a 64-bit hash: a polynomial
over its bytes taken from prefix sums (the multiplier is odd, so it can be divided out again modulo 2**64), then mixed.
The hash depends on the bytes alone, so it is the same in every task and every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import kept

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 3
_PI = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: A text is hashed in stretches of about so many bytes.
_STRETCH = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n at least. Those for a stretch are kept for the task, longer ones made anew."""
    if n <= _STRETCH + 1:
        return kept("powers", lambda: _powers(_STRETCH + 1))
    return _powers(n)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for p in (_P, _PI):
        x = np.full(size, p, U)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    return made[0], made[1]


@dataclass
class Words:
    data: np.ndarray  #: bytes of the texts, one after the other
    ends: np.ndarray  #: where each text ends
    starts: np.ndarray  #: where each word starts
    stops: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  #: of each text its first word, and in the end the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of the texts of an array without nulls."""
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def hash_ranges(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; ranges ascend and don't overlap."""
    h = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + _STRETCH, side="right")))
        at, to = int(starts[a]), int(stops[b - 1])
        power, inverse = _power(to - at + 1)
        sums = np.zeros(to - at + 1, U)
        np.cumsum(_VALUE[data[at:to]] * power[: to - at], out=sums[1:])
        s, e = starts[a:b] - at, stops[a:b] - at
        h[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
        a = b
    return h


def words(text: pa.StringArray, lower: bool = False, hashed: bool = True) -> Words:
    """Words of all texts of an array without nulls; lower: A-Z as a-z."""
    data, ends = text_bytes(text)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, ends, z, z, np.zeros(0, U), np.zeros(len(ends) + 1, np.int64))
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[0] = True
    edge[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, np.r_[0, ends])
    h = hash_ranges(data, starts, stops) if hashed else np.zeros(0, U)
    return Words(data, ends, starts, stops, h, first)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, as if all words stood in one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    s = h[:n].copy()
    for j in range(1, k):
        s = s * U(0xD6E8FEB86659FD93) + h[j : j + n]
        s ^= s >> U(32)
    return mix(s)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Of each text its distinct hashed k-word shingles, sorted; with fewer words, the whole sequence as one; none without words."""
    every = shingles(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            s = U(b - a)
            for x in w.hashes[a:b]:
                s = mix(np.array([s], U) * U(0xD6E8FEB86659FD93) + x)[0]
            out.append(np.array([s], U))
        else:
            out.append(np.zeros(0, U))
    return out
