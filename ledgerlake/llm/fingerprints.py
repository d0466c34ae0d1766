"""Document fingerprints: one-permutation MinHash, optimally densified, with b-bit values.

Each shingle of a text is hashed once; the top bits choose a bin, the others are its value, and a bin keeps its smallest.
An empty bin takes the value of a bin that a hash of its number and the attempt points to, tried again until that bin
isn't empty (so the choice is the same for all texts, as optimal densification asks). Of each value the low bits are
packed. Two values agree by chance with probability 2**-bits, which likeness() takes out again.

Defined cases: a text with fewer words than a shingle is one shingle; without words (or null) its fingerprint is an empty
string, like only other such texts; equal texts have equal fingerprints. In edited_pairs() the documents follow each
other by descending doc_id, null ids last, rows with equal ids by the hash of their text; the first one follows the last.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, over_chunks, partitions, text_chunks, tidy
from .textvec import U, mix, shingle_sets, words


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    bins: int = 512  #: a power of two
    bits: int = 4  #: of each bin: 1, 2, 4 or 8

    def pack(self, sets: list[np.ndarray]) -> list[bytes]:
        """Fingerprints of sets of hashes."""
        n, shift = len(sets), U(64 - (self.bins - 1).bit_length())
        size = np.fromiter(map(len, sets), np.int64, n)
        every = np.concatenate(sets) if n else np.zeros(0, U)
        empty = U(0xFFFFFFFFFFFFFFFF)
        values = np.full(n * self.bins, empty, U)
        np.minimum.at(values, np.repeat(np.arange(n) * self.bins, size) + (every >> shift).astype(np.int64), every & ((U(1) << shift) - U(1)))
        filled = values != empty
        hole = np.flatnonzero(~filled & np.repeat(size > 0, self.bins))
        source, attempt = np.arange(n * self.bins), 0
        while len(hole):
            attempt += 1
            number = (hole % self.bins).astype(U)
            to = hole - hole % self.bins + (mix(number * U(0x9E3779B97F4A7C15) + U(attempt * 0xC2B2AE3D27D4EB4F % 2**64)) % U(self.bins)).astype(np.int64)
            ok = filled[to]
            source[hole[ok]] = to[ok]
            hole = hole[~ok]
        low = (mix(values[source]) & U((1 << self.bits) - 1)).astype(np.uint8).reshape(n, self.bins)
        packed = np.zeros((n, self.bins * self.bits // 8), np.uint8)
        each = 8 // self.bits
        for i in range(each):
            packed |= low[:, i::each] << (i * self.bits)
        return [p.tobytes() if s else b"" for p, s in zip(packed, size.tolist())]

    def of_texts(self, text: pa.StringArray) -> list[bytes]:
        return self.pack(shingle_sets(words(text), self.words))

    def likeness(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Estimated Jaccard similarity, 0 to 1, of fingerprints pair by pair."""
        out = np.array([float(not p and not q) for p, q in zip(a, b)])
        both = [i for i, (p, q) in enumerate(zip(a, b)) if p and q]
        if both:
            x = np.frombuffer(b"".join(a[i] for i in both), np.uint8) ^ np.frombuffer(b"".join(b[i] for i in both), np.uint8)
            mask = (1 << self.bits) - 1
            same = sum(((x >> s) & mask) == 0 for s in range(0, 8, self.bits)).reshape(len(both), -1).sum(axis=1) / self.bins
            chance = 2.0**-self.bits
            out[both] = np.clip((same - chance) / (1 - chance), 0, 1)
        return out


@dataclass(frozen=True)
class Order:
    """The order of edited_pairs() - descending ids, null ids last, rows of one id by the hash of their text - cut into ranges.

    ids, hashes: the cuts among rows with ids, as (~id, hash), ascending. nulls: the cuts among rows without, as hashes."""

    ids: np.ndarray
    hashes: np.ndarray
    nulls: np.ndarray

    @property
    def count(self) -> int:
        return len(self.ids) + len(self.nulls) + 2

    def range_of(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        key = ~ids
        low, high = np.searchsorted(self.ids, key, side="left"), np.searchsorted(self.ids, key, side="right")
        out = high.copy()
        for at in np.unique(low[high > low]).tolist():  # cuts within the rows of one id
            own = (low == at) & (high > low)
            out[own] = at + np.searchsorted(self.hashes[at : int(high[own][0])], hashes[own], side="right")
        return np.where(null, len(self.ids) + 1 + np.searchsorted(self.nulls, hashes, side="right"), out).astype(np.int32)


def _hash_cuts(n: int) -> list[int]:
    """What cuts all hashes into n equal parts."""
    return [-(1 << 63) + (k << 64) // n for k in range(1, n)]


def order_of(own: DataFrame, parts: int) -> Order:
    """About `parts` ranges of equal numbers of rows: by quantiles of the ids, and by hash within an id or null that has more rows than a range."""
    told = own.agg(F.count("*").alias("n"), F.count("id").alias("with_id")).first()
    each = max(1, -(-told.n // parts))
    most = -(-told.with_id // each)
    wanted = [i / most for i in range(1, most)]
    cuts = sorted({int(~int(x)) for x in _quantiles(own, wanted, 1 / (4 * most))}) if wanted else []
    heavy = {r.id: r["count"] for r in own.where("id is not null").groupBy("id").count().where(F.col("count") > each).collect()}  # at most `parts`
    points = {(c, -(1 << 63)) for c in cuts} | {(~i, h) for i, n in heavy.items() for h in [-(1 << 63), *_hash_cuts(-(-n // each))]}
    points = sorted(points)
    nulls = _hash_cuts(max(1, -(-(told.n - told.with_id) // each)))
    return Order(np.array([p for p, _ in points], np.int64), np.array([h for _, h in points], np.int64), np.array(nulls, np.int64))


def _quantiles(own: DataFrame, wanted: list[float], error: float) -> list[int]:
    """Ids at these shares; percentile_approx keeps longs as they are."""
    row = own.agg(F.percentile_approx("id", wanted, int(1 / error)).alias("q")).first()
    return row.q or []


def edited_pairs(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """Per document doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next: see the module.

    Texts are shuffled once, into ranges of the order, a partition each; the first document of a range goes to the range
    before it as well, so that each finds the next one in its own task."""
    bounded_batches(docs.sparkSession)
    parts = partitions(docs, 2)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    order = order_of(own, parts)

    def places(part: pa.RecordBatch, id_: int, hash_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        null = part.column(id_).is_null().to_numpy(zero_copy_only=False)
        ids = part.column(id_).fill_null(0).to_numpy()
        hashes = part.column(hash_).to_numpy()
        return ids, null, hashes, order.range_of(ids, null, hashes)

    @tidy
    def tops(batches):
        """The first row of each range."""
        top: dict[int, tuple[bool, int, int]] = {}
        for b in batches:
            ids, null, hashes, at = places(b, 0, 1)
            first = np.lexsort((hashes, ~ids, at))
            first = first[np.r_[True, at[first][1:] != at[first][:-1]]] if len(first) else first
            for i in first.tolist():
                x = (bool(null[i]), int(~ids[i]), int(hashes[i]))
                top[int(at[i])] = min(x, top.get(int(at[i]), x))
        rows = [(k, *x) for k, x in top.items()]
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["range", "null", "key", "hash"])

    found = own.select("id", "hash").mapInArrow(tops, "range int, null boolean, key long, hash long").groupBy("range").agg(F.min(F.struct("null", "key", "hash")).alias("top")).collect()
    first = {r["range"]: tuple(r.top) for r in found}  # one for each range
    present = sorted(first)
    # rows like the first one of a range, and the range before it, where they are guests
    guest_of = {first[k]: before for before, k in zip(present, present[1:] + present[:1])}

    def deal(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        ids, null, hashes, at = places(part, 0, 2)
        twice = [(i, guest_of[x]) for i, x in enumerate(zip(null.tolist(), (~ids).tolist(), hashes.tolist())) if x in guest_of]
        take = pa.array([*range(len(ids)), *(i for i, _ in twice)], pa.int64())
        ranges = np.r_[at, np.array([k for _, k in twice], np.int32)].astype(np.int32)
        guest = np.r_[np.zeros(len(ids), bool), np.ones(len(twice), bool)]
        return pa.RecordBatch.from_arrays([part.column(0).take(take), text.take(take), part.column(2).take(take), pa.array(ranges), pa.array(guest)], names=["id", "text", "hash", "range", "guest"])

    dealt = own.mapInArrow(over_chunks(deal), "id long, text string, hash long, range int, guest boolean").repartitionById(order.count, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), "hash")

    @tidy
    def pair(batches):
        left = None  # (range, id, text, fingerprint, guest) of the row that waits for its next
        for batch in batches:
            for part, text in text_chunks(batch):
                prints = how.of_texts(text)
                rows = [] if left is None else [left]
                rows += zip(part.column(3).to_pylist(), part.column(0).to_pylist(), text.to_pylist(), prints, part.column(4).to_pylist())
                todo = [(a, b) for a, b in zip(rows, rows[1:]) if not a[4] and a[0] == b[0]]
                left = rows[-1]
                if not todo:
                    continue
                edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in todo]
                marks = how.of_texts(pa.array(edited, pa.string()))
                mine, following = [a[3] for a, _ in todo], [b[3] for _, b in todo]
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[1] for a, _ in todo], pa.int64()), pa.array([len(a[2]) for a, _ in todo], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([m.hex() for m in mine]), pa.array([m.hex() for m in marks]), pa.array(how.likeness(mine, marks)), pa.array(how.likeness(mine, following)),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
