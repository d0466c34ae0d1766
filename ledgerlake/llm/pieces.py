"""How tokenizers split texts, for many texts at once, and the ids of pieces that a worker has met before.

Texts are looked at as arrays of code points with a class each: white space, letter, digit, other sign, or (for word
tokenizers) one that only the library may normalise. Pieces begin where the class changes; the rules for single spaces,
the last white space of a run and contractions are then applied to all texts together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textvec import U, hash_ranges, text_bytes

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD, _UNKNOWN = range(6)


class Classes:
    """The class of each code point, found out when one is met first. of: characters to their classes."""

    def __init__(self, of: Callable[[str], int]):
        self.of, self.table = of, np.full(0x110000, _UNKNOWN, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        fresh = np.unique(points[out == _UNKNOWN])
        if len(fresh):
            self.table[fresh] = [self.of(chr(p)) for p in fresh.tolist()]
            out = self.table[points]
        return out


def byte_classes() -> Classes:
    """As byte-level tokenizers tell characters apart."""
    import regex

    kinds = [(regex.compile(r"\s").match, _SPACE), (regex.compile(r"\p{L}").match, _LETTER), (regex.compile(r"\p{N}").match, _DIGIT)]
    return Classes(lambda c: next((k for match, k in kinds if match(c)), _SIGN))


def word_classes() -> Classes:
    """ASCII and Latin-1 letters, digits and signs, which normalisation leaves alone but for case; all else is odd."""

    def of(c: str) -> int:
        if c in " \t\n\x0b\x0c\r":
            return _SPACE
        if "0" <= c <= "9":
            return _DIGIT
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" and c not in "×÷":
            return _LETTER
        return _SIGN if "!" <= c <= "~" or c in "×÷" else _ODD

    return Classes(of)


@dataclass
class Pieces:
    data: np.ndarray  #: bytes of the texts, as they are to be encoded
    starts: np.ndarray  #: where each piece starts
    stops: np.ndarray
    first: np.ndarray  #: of each text its first piece, and in the end the number of pieces
    odd: np.ndarray  #: of each piece whether the library is to encode it

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.stops)

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.stops[i]].tobytes()


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each starts."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.flatnonzero((data & 0xC0) != 0x80)


def _contractions(points: np.ndarray, kind: np.ndarray, change: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll are pieces where a match begins with them."""
    n = len(points)
    at = np.flatnonzero((points == 0x27) & change & start)
    at = at[at + 1 < n]
    at = at[change[at + 1] & ~edge[at + 1] & (kind[at + 1] == _LETTER)]
    if not len(at):
        return
    one = points[at + 1]
    after = np.minimum(at + 2, n - 1)
    two = np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], points[after], 0)
    r, v, l, e = (ord(c) for c in "rvle")
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = (((one == r) | (one == v)) & (two == e)) | ((one == l) & (two == l))
    hit = single | double
    at, size = at[hit], np.where(single[hit], 1, 2)
    start[at + 1] = False
    to = at + 1 + size
    start[to[to < n]] = True


def _prepared(text: pa.StringArray, classes: Classes):
    data, ends = text_bytes(text)
    points, at = _points(data)
    n = len(points)
    kind = classes(points)
    stops = np.searchsorted(at, ends)  # of each text, in code points
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[stops] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    return data, points, at, kind, stops, edge, change


def byte_pieces(text: pa.StringArray, classes: Classes) -> Pieces:
    """Pieces of byte-level tokenizers: all bytes of a text, a space with what follows it. Texts without special tokens."""
    data, points, at, kind, stops, edge, change = _prepared(text, classes)
    n = len(points)
    start = change.copy()
    space = kind == _SPACE
    # a run of white space before something else: its last character is on its own, or with what follows if it is a space
    after = np.flatnonzero(change & ~edge[:-1] & ~space) if n else np.zeros(0, np.int64)
    after = after[space[after - 1]]
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    _contractions(points, kind, change, edge, start)
    own = np.flatnonzero(start)
    first = np.searchsorted(own, np.r_[0, stops])
    begins = at[own]
    return Pieces(data, begins, np.r_[begins[1:], len(data)] if n else begins, first, np.zeros(len(own), bool))


def word_pieces(text: pa.StringArray, classes: Classes) -> Pieces:
    """Pieces of word tokenizers, in lower case, without white space; a word with odd characters, or one that may hold a
    special token, is a piece as it is."""
    data, points, at, kind, stops, edge, change = _prepared(text, classes)
    n = len(points)
    if not n:
        z = np.zeros(0, np.int64)
        return Pieces(data, z, z, np.zeros(len(text) + 1, np.int64), np.zeros(0, bool))
    solid = kind != _SPACE
    start = solid & (change | (kind == _DIGIT))
    _contractions(np.where((points >= 65) & (points <= 90), points + np.uint32(32), points), kind, change, edge, start)
    start &= solid
    word = solid.copy()  # where words begin
    word[1:] &= ~solid[:-1] | edge[1:-1]
    number = np.cumsum(word) - 1
    odd_word = np.zeros(int(word.sum()), bool)
    odd_word[number[kind == _ODD]] = True
    mark = np.flatnonzero((points[:-1] == 0x3C) & (points[1:] == 0x7C) & ~edge[1:-1])
    odd_word[number[mark]] = True
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1  # À-Þ but for ×
    accent = accent[(data[accent] <= 0x9E) & (data[accent] != 0x97)]
    low[accent] += 32
    if odd_word.any():
        inside = solid & odd_word[np.maximum(number, 0)]
        start = np.where(inside, word, start)
        raw = np.repeat(inside, np.diff(np.r_[at, len(data)]))
        low[raw] = data[raw]
    # a piece ends where the next one starts, or where white space or another text does
    own = np.flatnonzero(start)
    close = np.flatnonzero(start | ~solid | edge[:-1])
    ends = np.r_[close, n][np.searchsorted(close, own, side="right")]
    byte = np.r_[at, len(data)]
    return Pieces(low, at[own], byte[ends], np.searchsorted(own, np.r_[0, stops]), odd_word[number[own]])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class IdCache:
    """Ids of pieces, with the pieces' bytes, in arrays that are found by hash. At most about `limit` bytes: beyond it the
    entries used longest ago go, so that a worker's memory doesn't grow with what it reads."""

    def __init__(self, limit: int = 48 << 20):
        self.limit, self.clock = limit, 0
        self.keys, self.entry = np.zeros(0, U), np.zeros(0, np.int32)  # keys ascend
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.at, self.lengths, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.used = np.zeros(0, np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], -1)

    def _add(self, p: Pieces, which: np.ndarray, encode: Callable) -> np.ndarray:
        """New entries for the pieces with these numbers."""
        pool, starts, sizes = encode(p, which)
        length = (p.stops - p.starts)[which]
        new = np.arange(len(self.starts), len(self.starts) + len(which), dtype=np.int32)
        self.starts, self.sizes, self.pool = np.concatenate([self.starts, starts + len(self.pool)]), np.concatenate([self.sizes, sizes.astype(np.int32)]), np.concatenate([self.pool, pool.astype(np.uint32)])
        self.at = np.concatenate([self.at, len(self.bytes) + np.cumsum(length) - length])
        self.bytes = np.concatenate([self.bytes, p.data[ranges(p.starts[which], length)]])
        self.lengths = np.concatenate([self.lengths, length.astype(np.int32)])
        self.used = np.concatenate([self.used, np.full(len(which), self.clock, np.int32)])
        return new

    def _forget(self) -> None:
        self.clock += 1
        if self.nbytes() <= self.limit:
            return
        order = np.argsort(-self.used, kind="stable")  # the last used first, until half of the bytes are taken
        taken = np.cumsum(self.sizes[order] * 4 + self.lengths[order] + 44, dtype=np.int64)
        keep = np.sort(order[: int(np.searchsorted(taken, self.limit // 2))])
        number = np.full(len(self.starts), -1, np.int32)
        number[keep] = np.arange(len(keep), dtype=np.int32)
        self.pool, self.bytes = self.pool[ranges(self.starts[keep], self.sizes[keep])], self.bytes[ranges(self.at[keep], self.lengths[keep])]
        self.sizes, self.lengths, self.used = self.sizes[keep], self.lengths[keep], self.used[keep]
        self.starts, self.at = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        own = number[self.entry]
        self.keys, self.entry = self.keys[own >= 0], own[own >= 0]

    def entries(self, p: Pieces, encode: Callable[[Pieces, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The entry of each piece. encode: ids (pool, starts, sizes) of the pieces with these numbers."""
        self._forget()
        keys, one, inverse = np.unique(p.hashes(), return_index=True, return_inverse=True)
        entry = self._find(keys)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            entry[fresh] = self._add(p, one[fresh], encode)
            at = np.searchsorted(self.keys, keys[fresh])
            self.keys, self.entry = np.insert(self.keys, at, keys[fresh]), np.insert(self.entry, at, entry[fresh])
        self.used[entry] = self.clock
        out = entry[inverse]
        wrong = self._differ(p, out)
        if len(wrong):  # another piece has this hash
            out[wrong] = self._add(p, wrong, encode)
        return out

    def _differ(self, p: Pieces, entry: np.ndarray) -> np.ndarray:
        """Pieces whose bytes aren't those of their entry."""
        length = p.stops - p.starts
        ok = self.lengths[entry] == length
        own, n = entry[ok], length[ok]
        same = self.bytes[ranges(self.at[own], n)] == p.data[ranges(p.starts[ok], n)]
        if same.all():
            return np.flatnonzero(~ok)
        bad = np.add.reduceat(~same, np.cumsum(n) - n) > 0
        ok[np.flatnonzero(ok)[bad]] = False
        return np.flatnonzero(~ok)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries, one after the other, and where those of each begin (and the last end)."""
        n = self.sizes[entries]
        return self.pool[ranges(self.starts[entries], n)], np.r_[0, np.cumsum(n, dtype=np.int64)]
