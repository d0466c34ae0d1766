"""N-gram Jaccard join with PartEnum signatures.

A text's set holds the hashes of its distinct word shingles. Sets are banded by size; within a band two sets that are
similar enough differ in k elements at most. The domain is dealt into first-level parts, each into a few second-level
parts, and the signatures of a set are its projections on all subsets of so many second-level parts of each first-level
part that two sets with at most k differences must share one. Sets near the upper end of a band also sign for the next.
So no similar pair is missed; there is no random choice and no bucket is cut.

Texts with equal sets are one class from the start and are known by the hash of the set. Signatures go through
repeats.repeated() (one shuffle, nothing of it in one task because of a frequent signature). Then
 1. in each bucket all members are compared with its smallest one; a sketch (for each cell of the domain
    the parity of the set's elements there) bounds the differences from below, and pairs that pass are verified on the
    sets themselves. Verified links make components.
 2. buckets whose other members are in one component are done. In the others members of different components are compared
    by sketch, in blocks of bounded size that several tasks share if the bucket is large. Of those that pass, each member
    lists its nearest few; they are verified, and components grow together. This is done first with one bucket for each
    text, then with all. Buckets where some member had more are looked at again, with what is still apart and a longer
    list, until no list is too short.
Pairs aren't listed before a sketch has passed them, and none within a component, so a large group of near copies costs
a few links a member. In the end every pair that shares a signature is linked, verified not to be similar, or in one
component: the length of the lists decides how often pairs are looked at, not which.

Defined cases: a text with fewer words than a shingle is one shingle; without words (or null) it has none and is linked
with nothing; repeated rows are linked as equal texts; a null doc_id gets the smallest id of its component, if any;
columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, columns, over_chunks, partitions, tidy
from .repeats import marked, repeated
from .textvec import U, mix, shingle_sets, words

#: Second-level parts, and how many of them may differ; width of a band in steps of the similarity.
PARTS, DIFFER, STEPS = 3, 1, 2
#: Members of a bucket that one task compares at once; pairs that a member lists at first, and how much longer lists get;
#: rounds over one bucket of each text that come first.
BLOCK, NEAREST, LONGER, SINGLE_ROUNDS = 1024, 4, 16, 2


@dataclass(frozen=True)
class Similarity:
    """Links sets whose intersection is at least percent / 100 of their union."""

    percent: int = 80
    words: int = 5

    def differences(self, size: int) -> int:
        """Elements in which two similar sets of at most this size differ at most."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)


@lru_cache
def bands(percent: int) -> tuple[list[int], list[int]]:
    """Smallest and largest size of each band."""
    low, high, at = [], [], 1
    while at < 1 << 40:
        top = at
        for _ in range(STEPS):
            top = top * 100 // percent
        low.append(at)
        high.append(max(at, top))
        at = high[-1] + 1
    return low, high


_CHOICES = list(itertools.combinations(range(PARTS), PARTS - DIFFER))


def signatures(s: np.ndarray, sim: Similarity) -> np.ndarray:
    """Signatures of a set (distinct hashes)."""
    low, high = bands(sim.percent)
    band = bisect_right(low, len(s)) - 1
    out = []
    for b in (band, band + 1):
        k = sim.differences(high[b])
        if not k or b > band and 100 * len(s) < sim.percent * low[b]:
            continue  # without differences only equal sets are similar; or nothing in the next band is
        first = -(-(k + 1) // (DIFFER + 1))
        cells = np.zeros(first * PARTS, U)
        np.add.at(cells, (s % U(first * PARTS)).astype(np.int64), mix(s ^ U(b)))
        cells = cells.reshape(first, PARTS)
        number = np.arange(first, dtype=U) * U(len(_CHOICES))
        for c, chosen in enumerate(_CHOICES):
            h = mix(number + U(c + (b + 1 << 40)))
            for p in chosen:
                h = mix(h * U(0xD6E8FEB86659FD93) ^ cells[:, p])
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, U)


def sketch(s: np.ndarray, sim: Similarity) -> bytes:
    """For each of 2**c cells, at least twelve for each difference allowed, whether it holds an odd number of elements.
    A cell that differs between two sets holds a difference, and with so many cells few differences cancel out."""
    cells = 1 << max(6, (12 * sim.differences(len(s))).bit_length())
    return np.packbits((np.bincount((s & U(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch of `size` bytes with half, a quarter, ... of its cells."""
    x = np.frombuffer(raw, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, sim: Similarity) -> np.ndarray:
    """Whether sets of n and m elements can be similar if they have at least `differ` differences."""
    both = n + m
    return (100 * np.minimum(n, m) >= sim.percent * np.maximum(n, m)) & ((100 + sim.percent) * differ <= (100 - sim.percent) * both)


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def sets_of(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n (size of the set), d1, d2 (hashes of it; 0 if empty), sketch."""

    def run(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        sets = shingle_sets(words(text, lower=True), sim.words)
        d = np.array([_digest(s) if len(s) else (0, 0) for s in sets], np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([sketch(s, sim) if len(s) else b"" for s in sets], pa.binary())], names=["doc_id", "n", "d1", "d2", "sketch"])

    return docs.mapInArrow(over_chunks(run), "doc_id long, n long, d1 long, d2 long, sketch binary")


def _signed(docs: DataFrame, sim: Similarity) -> DataFrame:
    def run(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch | None:
        found = {}
        for s in shingle_sets(words(text, lower=True), sim.words):
            if len(s) and (d := int(_digest(s)[0])) not in found:
                found[d] = signatures(s, sim)
        if not found:
            return None
        key = np.concatenate(list(found.values()))
        owner = np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()])
        return marked(key, owner, np.zeros(len(key), np.int64))

    return docs.mapInArrow(over_chunks(run), "key long, owner long, place long")


def _passed(pairs: DataFrame, sketches: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) that their sketches allow."""
    both = pairs.join(sketches.selectExpr("id as a", "n as n_a", "sketch as sketch_a"), "a").join(sketches.selectExpr("id as b", "n as n_b", "sketch as sketch_b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    @tidy
    def run(batches):
        for x in batches:
            differ = np.empty(x.num_rows, np.int64)
            for i, (p, q) in enumerate(zip(x.column(4).to_pylist(), x.column(5).to_pylist())):
                size = min(len(p), len(q))
                differ[i] = np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum()
            ok = pa.array(may_link(x.column(2).to_numpy(), x.column(3).to_numpy(), differ, sim))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose sets are similar, written. Only texts that stand in a pair are looked at again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    where = texts.join(wanted, "id").select("id", F.col("doc_id").alias("at"))

    def sets(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        found = shingle_sets(words(text, lower=True), sim.words)
        d = [int(_digest(s)[0]) if len(s) else 0 for s in found]
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), part.column(2), pa.array([s.tobytes() for s in found], pa.binary())], names=["own", "id", "items"])

    items = docs.join(where, docs.doc_id.eqNullSafe(where["at"])).select("doc_id", "text", "id").mapInArrow(over_chunks(sets), "own long, id long, items binary").where("own = id").groupBy("id").agg(F.first("items").alias("items"))
    items = scratch.save(items, "items")  # so that AQE can split the pairs of a text that stands in many
    both = pairs.join(items.selectExpr("id as a", "items as items_a"), "a").join(items.selectExpr("id as b", "items as items_b"), "b").select("a", "b", "items_a", "items_b")

    @tidy
    def run(batches):
        for x in batches:
            ok = []
            for p, q in zip(x.column(2), x.column(3)):
                s, t = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * shared >= sim.percent * (len(s) + len(t) - shared))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], names=["a", "b"])

    out = scratch.save(both.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(items)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (its smallest id) of all ends of links (a, b): smallest labels of neighbours, with pointer jumping."""
    ways = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), "ways")
    labels = scratch.save(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        near = ways.join(labels.selectExpr("id as b", "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        jumped = lower.join(labels.selectExpr("id as to", "component as further"), "to", "left").select("id", F.least("to", F.coalesce("further", "to")).alias("component"), "before")
        after = scratch.save(jumped, "labels")
        moved = after.where("component <> before").limit(1).count()
        scratch.drop(labels)
        labels = after.drop("before")
        labels._scratch_path = after._scratch_path
        if not moved:
            scratch.drop(ways)
            return labels


def _unresolved(buckets: DataFrame, lead: DataFrame, labels: DataFrame, sketches: DataFrame, sim: Similarity, partitions: int, nearest: int, seed: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and that their sketches allow; pairs with the bucket's smallest
    member aside. Of the members after it in a block each lists the nearest ones; where one had more, a row without b has
    the bucket as a. seed: each text is looked at in one of its buckets only, the same for many of those like it."""
    rows = buckets.join(labels.selectExpr("id as owner", "component"), "owner", "left").withColumn("component", F.coalesce("component", "owner"))
    others = rows.join(lead, "key").where("owner <> lead").select("key", "owner", "component")
    told = others.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("owner")).alias("x"), F.bit_xor(F.xxhash64("owner", F.lit(1))).alias("y"))
    # buckets with the same members are compared once
    todo = told.where("low <> high").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("owner", F.lit(2)), F.col("blocks").cast("long")).cast("int")
    chosen = others.join(todo, "key")
    if seed is not None:
        one = F.min_by(F.struct("key", "component", "blocks"), F.xxhash64("key", F.lit(seed)))
        chosen = chosen.groupBy("owner").agg(one.alias("p")).select("owner", "p.key", "p.component", "p.blocks")
    dealt = chosen.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "owner", "component").join(sketches.selectExpr("id as owner", "n", "sketch"), "owner")
    cells = cells.select("key", "i", "j", "block", "owner", "component", "n", "sketch").repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(rows: list[tuple]) -> list[tuple[int, int | None]]:
        rows = sorted(rows, key=lambda r: r[4])
        size = min(len(r[7]) for r in rows)
        sketches = np.stack([_folded(r[7], size) for r in rows])
        block, owner, component, n = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
        apart, out, cut = rows[0][1] != rows[0][2], [], False
        for x in range(len(rows) - 1):
            y = x + 1 + np.flatnonzero((component[x + 1 :] != component[x]) & ((block[x + 1 :] != block[x]) if apart else True) & may_link(n[x + 1 :], n[x], np.abs(n[x + 1 :] - n[x]), sim))
            if len(y):
                differ = np.bitwise_count(sketches[y] ^ sketches[x]).sum(axis=1, dtype=np.int64)
                ok = may_link(n[y], n[x], differ, sim)
                y, differ = y[ok], differ[ok]
                if len(y) > nearest:
                    y, cut = y[np.argsort(differ, kind="stable")[:nearest]], True
                out += [(owner[x], o) for o in owner[y]]
        return [*out, (rows[0][0], None)] if cut else out

    @tidy
    def run(batches):
        at, held = None, []
        done: set[tuple[int, int | None]] = set()

        def close():
            new = [p for p in (compare(held) if len(held) > 1 else []) if p not in done]
            done.update(new)
            if len(done) > 1_000_000:
                done.clear()
            a, b = zip(*new) if new else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] != at:
                    if (out := close()).num_rows:
                        yield out
                    at, held = r[:3], []
                held.append(r)
        if (out := close()).num_rows:
            yield out

    return cells.mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """doc_id, n, d1, d2 (size and hashes of the set) and c1, c2 (the component, where the set isn't empty) of each document."""
    parts = partitions(docs, 4)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = scratch.save(sets_of(own, sim), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n", "sketch"))
    texts = scratch.save(table.where("n > 0").groupBy(F.col("d1").alias("id")).agg(first.alias("f")).select("id", "f.doc_id", "f.n", "f.sketch"), "texts")
    sketches, where = texts.select("id", "n", "sketch"), texts.select("id", "doc_id")
    table = table.drop("sketch")

    buckets = scratch.save(repeated(_signed(own, sim), parts).select("key", "owner").distinct(), "buckets")
    lead = scratch.save(buckets.groupBy("key").agg(F.min("owner").alias("lead")), "lead")
    star = buckets.join(lead, "key").where("lead <> owner").select(F.col("lead").alias("a"), F.col("owner").alias("b")).distinct()
    near = scratch.save(_passed(star, sketches, sim), "near")
    links = _verified(near, own, where, sim, scratch)
    scratch.drop(near)
    labels = components(links, scratch)

    def grow(pairs: DataFrame) -> None:
        """Verified pairs become links."""
        nonlocal links, labels
        if pairs.limit(1).count():
            new = _verified(pairs, own, where, sim, scratch)
            if new.limit(1).count():
                links = links.union(new)
                labels = components(links, scratch)

    # most members of large groups find a link in one bucket, which leaves few of them to the rounds over all buckets
    for seed in range(SINGLE_ROUNDS):
        grow(scratch.save(_unresolved(buckets, lead, labels, sketches, sim, parts, NEAREST, seed), "single").where("b is not null"))
    open_, nearest = buckets, NEAREST
    while True:
        more = scratch.save(_unresolved(open_, lead, labels, sketches, sim, parts, nearest), "more")
        grow(more.where("b is not null"))
        cut = more.where("b is null").select(F.col("a").alias("key")).distinct()
        if not cut.limit(1).count():
            break
        # all pairs of the other buckets have been looked at
        open_ = scratch.save(buckets.join(cut, "key", "left_semi"), "open")
        nearest *= LONGER
    scratch.drop(buckets, lead)

    return table.join(labels.selectExpr("id as d1", "component"), "d1", "left").select("doc_id", "n", "d1", "d2", F.coalesce("component", "d1").alias("c1"), F.when(F.col("component").isNull(), F.col("d2")).otherwise(0).alias("c2"))


def join_classes(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles, component_id, d1, d2 (hashes of the set) of each document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    linked = _linked(docs, sim, scratch)
    # written, so that the join has a table on each side and AQE can split the rows of a large component
    lowest = scratch.save(linked.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("lowest")), "lowest")
    out = linked.join(lowest, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"), "d1", "d2")


def _with_digest(rows: DataFrame, sim: Similarity) -> DataFrame:
    """row, doc_id, text with d1, d2 (hashes of each set; 0 if empty)."""
    shape = StructType([*rows.schema.fields, StructField("d1", LongType()), StructField("d2", LongType())])

    def run(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        d = np.array([_digest(s) if len(s) else (0, 0) for s in shingle_sets(words(text, lower=True), sim.words)], np.int64)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=[*part.schema.names, "d1", "d2"])

    return rows.mapInArrow(over_chunks(run), shape)


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The first row of each component, by id (null last), then by the hash of its set, then by its text; rows without words
    stay. All columns unchanged, whatever their names. Ids that stand once decide by themselves; the rows of other ids and of null are told apart."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    linked = scratch.save(_linked(docs, sim, scratch), "linked")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "d1", "d2")
    # written, so that the join has a table on each side and AQE can split the rows of a large component
    first = scratch.save(linked.where("n > 0").groupBy("c1", "c2").agg(F.min(place).alias("first")), "first")
    gone = linked.where("n > 0").join(first, ["c1", "c2"]).where(place != F.col("first")).select(F.col("doc_id").alias("gone"), F.col("d1").alias("gone1"), F.col("d2").alias("gone2")).distinct()
    several = scratch.save(linked.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("several")), "several")
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    back = lambda kept: kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
    if not several.limit(1).count():
        return back(rows.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"))
    dropped = gone.select("gone").union(several).distinct()
    single = rows.where(F.col("doc_id").isNotNull()).join(dropped, F.col("doc_id") == F.col("gone"), "left_anti")
    others = _with_digest(rows.where(F.col("doc_id").isNull()).union(rows.join(several, F.col("doc_id") == F.col("several"), "left_semi")), sim)
    left = others.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("d1") == F.col("gone1")) & (F.col("d2") == F.col("gone2")), "left_anti")
    empty = (F.col("d1") == 0) & (F.col("d2") == 0)
    once = left.where(~empty).groupBy("doc_id", "d1", "d2").agg(F.min_by("row", "text").alias("row"))
    return back(single.select("row").union(left.where(empty).select("row")).union(once.select("row")))
