"""Best-fit packing by planning over the histogram of lengths.

Texts are encoded once; longer ones are cut into pieces of the sequence length. The driver gets one count for each
length (2048 of them at most) and places whole counts, longest first, into the sequences with the least room that
suffices: a plan of runs, each of which says that so many pieces of one length fill consecutive sequences, so many to a
sequence. Pieces then get a rank within their length - numbered within salted groups, plus the size of the groups
before, so that no length lands in one task - and take the slot that the plan has for this rank.

The plan has a few rows for each length and doesn't grow with the documents, so it can be broadcast.

Defined cases: a null or empty text is the final id alone; repeated rows and null ids are packed as rows of their own;
an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import WordBpe
from .common import Scratch, kept, over_chunks
from .pieces import IdCache, Pieces, ranges, word_classes, word_pieces

SEQUENCE, END_ID = 2048, 0


@dataclass(frozen=True)
class Run:
    """Pieces of `length` with ranks from first_rank take per_sequence slots each of consecutive sequences, from `offset` on."""

    length: int
    first_rank: int
    count: int
    sequence: int
    per_sequence: int
    offset: int


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[Run]:
    """Best fit decreasing over counts. Sequences with the same room are kept as ranges of numbers."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges (first sequence, how many)
    runs: list[Run] = []
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        free = min((r for r in room if r >= length), default=size)
        while left:
            if free not in room:  # new sequences
                need = -(-left // (size // length))
                room.setdefault(size, []).append((made, need))
                made += need
                free = size
            first, n = room[free].pop()
            if not room[free]:
                del room[free]
            each = free // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, full * each, first, each, size - free))
                left, rank = left - full * each, rank + full * each
                if rest := free - each * length:
                    room.setdefault(rest, []).append((first, full))
            if full < n and left:  # the last pieces, fewer than one sequence takes
                runs.append(Run(length, rank, left, first + full, each, size - free))
                if rest := free - left * length:
                    room.setdefault(rest, []).append((first + full, 1))
                full, left = full + 1, 0
            if full < n:
                room.setdefault(free, []).append((first + full, n - full))
            free = min((r for r in room if r >= length), default=size)
    return runs


class WordEncoder:
    """Token ids of many texts at once for a tokenizer that never joins across ASCII white space.

    Words of plain Latin letters, digits and signs are split and merged here, many at a time; all others, and those that
    may hold a special token, go through the tokenizers library. What a worker has met before it knows (IdCache)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges, self.classes, self.cache = WordBpe(path), word_classes(), IdCache()

    def _ids(self, p: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain, odd = np.flatnonzero(~p.odd[which]), np.flatnonzero(p.odd[which])
        first, count = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        pool, first[plain], count[plain] = self.merges.merge_all(p.data, p.starts[which[plain]], p.stops[which[plain]])
        if len(odd):
            made = self.tokenizer.encode_batch([p.raw(i).decode() for i in which[odd].tolist()], add_special_tokens=False)
            ids = [e.ids for e in made]
            count[odd] = [len(x) for x in ids]
            first[odd] = len(pool) + np.cumsum(count[odd]) - count[odd]
            pool = np.concatenate([pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(count[odd].sum()))])
        return pool, first, count

    def encode(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin (and the last end)."""
        p = word_pieces(text, self.classes)
        flat, at = self.cache.ids(self.cache.entries(p, self._ids))
        return flat, at[p.first]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""

    def cut(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        flat, at = kept("words", lambda: WordEncoder(tokenizer)).encode(text)
        own = np.diff(at)
        doc = np.arange(len(own))
        ids = np.full(len(flat) + len(own), END_ID, "<u4")
        ids[np.arange(len(flat)) + np.repeat(doc, own)] = flat
        n = -(-(own + 1) // size)  # pieces of each text
        doc = np.repeat(doc, n)
        piece = ranges(np.zeros(len(n), np.int64), n)
        length = np.minimum(size, own[doc] + 1 - piece * size)
        edge = np.r_[0, np.cumsum(length)]
        raw = memoryview(ids.tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        columns = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length), pa.array(sums, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(over_chunks(cut, limit=2 << 20), shape)


def ranked(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """The pieces with their rank (from 0) within their length."""
    parts = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # no group of a length and a salt holds more than a quarter of a partition's share of the pieces
    salts = max(1, -(-4 * parts * max(histogram.values()) // sum(histogram.values())))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, size, with_ids), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    more = ["ids"] * with_ids
    if not histogram:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *more)
    runs = plan(histogram, size)
    slots = spark.createDataFrame([(r.length, r.first_rank, r.count, r.sequence, r.per_sequence, r.offset) for r in runs], "length long, first_rank long, n long, sequence long, per_sequence long, base long")
    inside = F.col("rank") - F.col("first_rank")
    found = ranked(cut, histogram).alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first_rank")) & (inside < F.col("n")))
    return found.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("sequence") + F.floor(inside / F.col("per_sequence"))).cast("long").alias("sequence_id"), (F.col("base") + inside % F.col("per_sequence") * F.col("p.length")).cast("long").alias("offset"), *more)
