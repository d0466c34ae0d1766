"""Which keys do several owners hold? With one shuffle, whatever the most frequent key.

Rows are (key, owner, place) or (key, owner, place, text), where text tells texts of one owner apart. A task first looks at the rows of a stretch of its own input: of the rows with one key only
the one with the smallest owner goes on under that key, marked if the stretch has others; those others are known to be
repeats already and are dealt out by a hash of their own, so a key in a third of all rows sends one row a stretch to its
task. There rows come sorted, and are streamed: no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy
from .textvec import U

SHAPE = "key long, owner long, place long"
TEXT_SHAPE = SHAPE + ", text long"
#: Low bits of place as it is shuffled: 0 alone in its stretch, 1 first of several, 2 one of the others.
_ALONE, _FIRST, _OTHER = 0, 1, 2


def marked(key: np.ndarray, owner: np.ndarray, place: np.ndarray, text: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one stretch, ready to be dealt. place: below 2**61."""
    key = key.view(np.int64)
    order = np.lexsort((place, owner, key))
    key, owner, place = key[order], owner[order], place[order]
    start = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(start)
    size = np.diff(np.r_[at, len(key)])
    lowest = np.repeat(owner[at], size)
    several = np.repeat(np.maximum.reduceat(owner, at) != owner[at], size) if len(key) else start
    mark = np.where(owner != lowest, _OTHER, np.where(several, _FIRST, _ALONE))
    more = [] if text is None else [pa.array(text[order])]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(place << 2 | mark), *more], names=["key", "owner", "place", *["text"] * len(more)])


def repeated(rows: DataFrame, partitions: int, later: bool = False) -> DataFrame:
    """Of rows from marked(), those whose key has several owners; later: those whose key has a smaller owner too."""
    names = ["key", "owner", "place", *["text"] * ("text" in rows.columns)]
    salt = F.when(F.col("place").bitwiseAND(F.lit(3)) == _OTHER, F.xxhash64(*names[1:])).otherwise(F.lit(0))
    dealt = rows.repartition(partitions, F.xxhash64("key", salt)).sortWithinPartitions("key", "owner")

    @tidy
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lowest, open_group = None, None, False  # of the group at the end of the last batch; open_group: known to be repeated
        held: dict[tuple[int, ...], None] = {}  # its distinct rows, all of the smallest owner, while nobody knows
        for b in batches:
            if not b.num_rows:
                continue
            key, owner, told = (b.column(i).to_numpy() for i in range(3))
            more = [b.column(i).to_numpy() for i in range(3, len(names))]
            place, mark = told >> 2, told & 3
            start = np.r_[True, key[1:] != key[:-1]]
            at = np.flatnonzero(start)
            size = np.diff(np.r_[at, len(key)])
            low = owner[at].copy()
            goes_on = key[0] == last
            if goes_on:
                low[0] = lowest
            low_each = np.repeat(low, size)
            many = np.maximum.reduceat(((owner != low_each) | (mark != _ALONE)).astype(np.int8), at) > 0
            if goes_on and open_group:
                many[0] = True
            out = [([key, owner, place, *more], (np.repeat(many, size) & ~((owner == low_each) & (mark != _OTHER))) if later else np.repeat(many, size))]
            if held and goes_on and many[0] and not later:
                h = np.array(list(held), np.int64)
                out.insert(0, (list(h.T), np.ones(len(h), bool)))
            if not (goes_on and len(at) == 1 and not many[0]):
                held = {}
            if not many[-1] and not later:
                held |= {tuple(int(c[i]) for c in (key, owner, place, *more)): None for i in range(at[-1], len(key))}
            last, lowest, open_group = key[-1], low[-1], bool(many[-1])
            for columns, keep in out:
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

    return dealt.mapInArrow(stream, TEXT_SHAPE if len(names) > 3 else SHAPE)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)
