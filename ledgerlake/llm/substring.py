"""Substring dedup by level-wise doubling.

A window of L words is named by a hash of its two halves, so the names at one length come from those at half of it (two
overlapping windows where the length is odd). Levels go from short windows to ones of twice their length, up to the target
length: 7 and 13 words for 13, or 7, 13, 25, 50 for 50. Only windows that repeat at one length are extended to the next;
the loop ends when no candidate survives.
At a level below the last each candidate of the target length stands under the smallest name of the windows of the level's
length inside it: equal candidates have equal smallest names, so one short window in four is enough, and a candidate whose
smallest name no other text holds doesn't survive. At the last level only the candidates that survived get a full name, and
the first owner of each name is the document with the smallest id.

Texts with the same words are one text up to the end: the smallest doc_id stands for them, and of the others every
window repeats. Names are exchanged through repeats.repeated(): one shuffle a level, no group in one task, no pairs.
Texts are shuffled by the hash of their words, once.

Defined cases: a null text has no words; texts below the window length lose nothing; rows that share a doc_id count as
one document with several texts (a window isn't removed for standing in another text of the same id); null ids come
after all others (the id 2**63 - 1 counts as one document with them); an empty table gives no rows; of other columns, whatever
their names, those asked for come back as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch, columns, over_chunks, partitions, tidy
from .repeats import TEXT_SHAPE, marked, repeated
from .textvec import U, Words, mix, words

WINDOW = 13
#: Stands for a null doc_id within this module: after all others.
_LAST = (1 << 63) - 1


def names(h: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of `length` words, by doubling."""
    s, n = h, 1
    while n < length:
        step = min(n, length - n)
        if len(s) <= step:
            return np.zeros(0, U)
        s = mix(s[:-step] * U(0xD6E8FEB86659FD93) + (s[step:] ^ (s[step:] >> U(29))))
        n += step
    return s


def levels(window: int) -> list[int]:
    """The lengths of windows, each at most twice the one before, up to the target."""
    out = [window]
    while out[0] > 7 or len(out) == 1 and window > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def smallest_names(h: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window of the target length the smallest name of the windows of `length` words in it."""
    short = names(h, length)
    w = window - length + 1
    n = len(short) - w + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have = short, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _spans(w: Words) -> list[tuple[int, int]]:
    return list(zip(w.first[:-1].tolist(), w.first[1:].tolist()))


def _digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the sequence of words of each text."""
    out = np.zeros((2, len(w.first) - 1), np.int64)
    for i, (a, b) in enumerate(_spans(w)):
        d = hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=16).digest()
        out[:, i] = np.frombuffer(d, np.int64)
    return out[0], out[1]


def _scan(docs: DataFrame, length: int, window: int) -> DataFrame:
    """doc_id, d1, d2 (hashes of the words), n_words, and marks: the distinct smallest names at this length."""

    def run(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        w = words(text)
        low = smallest_names(w.hashes, length, window)
        d1, d2 = _digests(w)
        marks = [np.unique(low[a : b - window + 1]) if b - a >= window else low[:0] for a, b in _spans(w)]
        ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
        flat = np.concatenate(marks).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(d1), pa.array(d2), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "d1", "d2", "n_words", "marks"])

    return docs.mapInArrow(over_chunks(run), "doc_id long, d1 long, d2 long, n_words long, marks array<long>")


#: Marks that a task looks at together before it sends them, and rows of one batch that it sends.
STRETCH, BATCH = 1 << 20, 1 << 16


def _mark_rows(marks: DataFrame) -> DataFrame:
    """Rows for repeated() from d1 and marks: of copies of a text that a stretch has, the marks of one."""

    @tidy
    def run(batches):
        held: dict[int, np.ndarray] = {}
        size = 0

        def told():
            owner = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
            out = marked(np.concatenate(list(held.values())), owner, np.zeros(len(owner), np.int64))
            held.clear()
            for a in range(0, out.num_rows, BATCH):
                yield out.slice(a, BATCH)

        for b in batches:
            lists = b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for d, p, q in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if d not in held:
                    held[d] = flat[p:q].copy()
                    size += q - p
                    if size >= STRETCH:
                        yield from told()
                        size = 0
        if held:
            yield from told()

    return marks.mapInArrow(run, "key long, owner long, place long")


def _with_digest(docs: DataFrame) -> DataFrame:
    def run(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        d1, d2 = _digests(words(text))
        return pa.RecordBatch.from_arrays([part.column(0), text, pa.array(d1), pa.array(d2), part.column(2)], names=["doc_id", "text", "d1", "d2", "carried"])

    return docs.mapInArrow(over_chunks(run), _shape("doc_id long, text string, d1 long, d2 long", docs.schema["carried"]))


def _shape(ddl: str, *more: StructField) -> StructType:
    return StructType([*StructType.fromDDL(ddl).fields, *more])


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), text (without the removed words; the
    rest as it was) and spans (first word and how many, of each removed stretch). carry: further columns, which come back
    as fields of the struct `carried`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    parts = partitions(docs, 4)
    id_ = F.col("doc_id").cast("long")
    rest = [c for c, name in zip(columns(docs), docs.columns) if name in (carry or ())]
    with_more = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(id_.alias("id"), F.struct(F.lit(0), *rest).alias("row")).alias("carried"))
    own = with_more.select("doc_id", "text")
    every = levels(window)
    scanned = scratch.save(_scan(own, every[0], window), "scan")
    # several texts of one id are told apart by d1
    texts = scratch.save(scanned.groupBy("d1", "d2").agg(F.min("doc_id").alias("lowest")), "texts")
    dealt = _with_digest(with_more)  # its exchange serves both joins; AQE splits the partition of a much copied text

    def survivors(low: np.ndarray, marks: pa.ListScalar) -> np.ndarray:
        """Where candidates start whose smallest name several texts hold."""
        return np.flatnonzero(np.isin(low.view(np.int64), marks.values.to_numpy(zero_copy_only=False)))

    def candidates(alive: DataFrame) -> DataFrame:
        """The text that stands for its copies, if it has candidates, with what survived."""
        return dealt.join(texts.join(alive, "d1"), ["d1", "d2"]).where("doc_id = lowest").select("doc_id", "text", "d1", "marks")

    def at_level(before: int, length: int) -> Callable:
        def run(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
            w = words(text)
            low, now = smallest_names(w.hashes, before, window), smallest_names(w.hashes, length, window)
            left = [np.unique(now[a + survivors(low[a : b - window + 1], part.column(3)[i])]) if b - a >= window else now[:0] for i, (a, b) in enumerate(_spans(w))]
            ends = np.cumsum([0, *map(len, left)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([part.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(left).view(np.int64)))], names=["d1", "marks"])

        return run

    alive, marks = None, scanned.where("n_words > 0").select("d1", "marks")
    for before, length in zip((0, *every), every[:-1]):
        if alive is not None:
            marks = candidates(alive).mapInArrow(over_chunks(at_level(before, length)), "d1 long, marks array<long>")
        held = repeated(_mark_rows(marks), parts).groupBy(F.col("owner").alias("d1")).agg(F.collect_set("key").alias("marks"))
        alive = scratch.save(held, f"alive-{length}")
        if not alive.limit(1).count():
            break
    scratch.drop(scanned)

    def extend(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch | None:
        w = words(text)
        low, full = smallest_names(w.hashes, every[-2], window), names(w.hashes, window)
        ids, digests = part.column(0).to_pylist(), part.column(2).to_pylist()
        keys, owners, places, texts = [], [], [], []
        for i, (a, b) in enumerate(_spans(w)):
            if b - a >= window:
                at = survivors(low[a : b - window + 1], part.column(3)[i])
                keys.append(full[a + at])
                owners.append(np.full(len(at), ids[i], np.int64))
                places.append(at)
                texts.append(np.full(len(at), digests[i], np.int64))
        return marked(*map(np.concatenate, (keys, owners, places, texts))) if keys else None

    # the last level: full names of the candidates that survived
    later = repeated(candidates(alive).mapInArrow(over_chunks(extend), TEXT_SHAPE), parts, later=True)
    found = later.groupBy(F.col("owner").alias("lowest"), F.col("text").alias("d1")).agg(F.collect_list(F.col("place").cast("int")).alias("starts"))
    cuts = texts.join(found, ["lowest", "d1"], "left").select("d1", "d2", "lowest", "starts")

    def cut(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        w = words(text, hashed=False)
        copy, starts = part.column(2).to_pylist(), part.column(3)
        n_words, n_removed, sums, kept_texts, spans = [], [], [], [], []
        for i, (a, b) in enumerate(_spans(w)):
            n = b - a
            gone = np.zeros(n + 1, np.int64)
            if n >= window:
                if copy[i]:
                    gone[0], gone[n] = 1, -1
                elif starts[i].is_valid:
                    s = np.unique(starts[i].values.to_numpy(zero_copy_only=False))
                    gone[s] += 1
                    gone[s + window] -= 1
            gone = np.cumsum(gone)[:n] > 0
            raw = w.data[(w.ends[i - 1] if i else 0) : w.ends[i]].tobytes()
            every = raw.split()
            n_words.append(n)
            n_removed.append(int(gone.sum()))
            if n_removed[-1]:
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                base = w.ends[i - 1] if i else 0
                left, out = 0, []
                for p, q in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    out.append(raw[left : w.starts[a + p] - base])
                    left = int(w.starts[a + q] - base) if q < n else len(raw)
                out.append(raw[left:])
                kept_texts.append(b"".join(out).decode())
                spans.append([{"word": int(p), "n": int(q - p)} for p, q in zip(edge[::2], edge[1::2])])
                every = [x for x, g in zip(every, gone.tolist()) if not g]
            else:
                kept_texts.append(raw.decode())
                spans.append([])
            sums.append(hashlib.sha256(b" ".join(every)).hexdigest())
        span = pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int32())]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums), pa.array(kept_texts, pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "spans"])

    def cut_and_carry(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        out = cut(part, text)
        return pa.RecordBatch.from_arrays([*out.columns, part.column(4)], names=[*out.schema.names, "carried"])

    joined = dealt.join(cuts, ["d1", "d2"]).select("doc_id", "text", (F.col("doc_id") > F.col("lowest")).alias("copy"), "starts", "carried")
    out = joined.mapInArrow(over_chunks(cut_and_carry), _shape("doc_id long, n_words long, n_removed long, kept_sha256 string, text string, spans array<struct<word:int,n:int>>", dealt.schema["carried"]))
    more = [F.col("carried.row").alias("carried")] if carry else []
    return out.select(F.col("carried.id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "text", "spans", *more)


def dedup_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words gone, and n_chars as it is now. A text that lost all its words goes with them: all of it stands elsewhere."""
    names = docs.columns
    carry = [c for c in names if c not in ("doc_id", "text")]
    out = remove_repeats(docs, window, carry).where("n_removed = 0 or n_removed < n_words")
    made = {c: F.col("carried")[c] for c in carry} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(made["n_chars"])
    return out.select(*(made[c].alias(c) for c in names))
