"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

The frequent words of the corpus - counted over all documents - are encoded once and compiled into a minimal acyclic
automaton: words with the same suffixes share states, and the numbers on a word's transitions add up to its rank, under
which its ids are stored. The file is written to the shared folder, sent to each executor by SparkContext.addFile, and
memory-mapped there, so that all workers of an executor share its pages. Words of a text that the automaton accepts take
their ids from it; all others are merged, pair by pair in the order of the merge list, so the result is exact whatever
the lexicon holds. Decoding joins the bytes of the ids.

Texts are never shuffled; what is shuffled is one count for each word of a task. The lexicon has a fixed number of words
at most, so what the driver collects is bounded.

Defined cases: a null text is empty and has no tokens; the text of a special token is that token, as the tokenizer has
it; repeated rows and null ids give a row each; an empty table gives no rows and an empty lexicon.
"""

from __future__ import annotations

import hashlib
import json
import mmap
from collections import Counter
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, hadoop_fs, kept, over_chunks, raw_texts, tidy
from .pieces import IdCache, Pieces, byte_classes, byte_pieces, ranges

#: Words in the lexicon at most, and bytes in one of them.
LEXICON_WORDS, WORD_BYTES = 65_536, 48
_MAGIC = b"MATL0001"


# --- the automaton


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic automaton of distinct words, each with a list of ids; words by rank in byte order."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    # the path of the last word, still open: (final, settled arcs) of each state on it
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    last = b""

    def close(to: int) -> None:
        while len(path) - 1 > to:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))

    for word, _ in entries:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(shared)
        path.extend((False, []) for _ in range(len(word) - shared))
        path[-1] = (True, path[-1][1])
        last = word
    close(0)
    root = settle(*path[0])
    below = np.zeros(len(states), np.int64)  # words that end in or after a state; targets are settled before sources
    keys, targets, skips = [], [], []
    for i, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, to in arcs:
            keys.append(i << 8 | byte)
            targets.append(to)
            skips.append(n)
            n += int(below[to])
        below[i] = n
    pool = np.array([x for _, ids in entries for x in ids], np.uint32)
    parts = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([s[0] for s in states], np.uint8), np.cumsum([0, *(len(ids) for _, ids in entries)]).astype(np.int64), pool]
    head = np.array([root, *(len(p) for p in parts)], np.int64).tobytes()
    out = bytearray(_MAGIC + head)
    for p in parts:
        out += b"\0" * (-len(out) % 8)
        out += p.tobytes()
    return bytes(out)


class Lexicon:
    """A compiled lexicon over any buffer, such as a memory-mapped file."""

    def __init__(self, buffer):
        if bytes(buffer[:8]) != _MAGIC:
            raise ValueError("not a lexicon")
        head = np.frombuffer(buffer, np.int64, 7, 8)
        self.root, at, parts = int(head[0]), 8 + 56, []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32)):
            at += -at % 8
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += parts[-1].nbytes
        self.keys, self.targets, self.skips, self.final, self.starts, self.pool = parts

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Of each range of bytes its rank as a word, or -1: all take a step at a time."""
        size = stops - starts
        out = np.full(len(size), -1, np.int64)
        if not len(size) or not len(self.keys):
            return out
        live = np.flatnonzero(size <= WORD_BYTES)
        state, rank, step = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            done = size[live] == step
            if done.any():
                ends = done & (self.final[state] > 0)
                out[live[ends]] = rank[ends]
                live, state, rank = live[~done], state[~done], rank[~done]
                if not len(live):
                    break
            key = state << 8 | data[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, rank = self.targets[arc].astype(np.int64), rank[ok] + self.skips[arc]
            step += 1
        return out

    def ids(self, rank: int) -> list[int]:
        return self.pool[self.starts[rank] : self.starts[rank + 1]].tolist()


# --- the merges


class Merges:
    """Pair merges over bytes: the symbol of each byte, of a last byte, and for each pair its rank and what it becomes."""

    #: Widths that words are sorted into, and words that are merged together.
    WIDTHS, BLOCK = (3, 4, 6, 8, 10, 12, 16, 24, 32, 64), 16_384

    def __init__(self, single: list[int], last: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.single, self.last = np.array(single, np.int32), np.array(last, np.int32)
        keys = np.array([x << 32 | y for x, y in merges], np.int64)
        order = np.argsort(keys)
        ranks = np.array([r for r, _ in merges.values()], np.int32)
        self.no_rank = int(ranks.max()) + 1
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.made = np.zeros(self.no_rank + 1, np.int32)
        self.made[ranks] = [new for _, new in merges.values()]
        # most pairs are found where their hash says; of a slot that several share, all but one are searched for
        self.bits = max(4, len(keys).bit_length() + 2)
        slot = self._slots(self.pair_keys)
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.no_rank, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = self.pair_keys, self.pair_ranks
        self.shared = np.bincount(slot, minlength=1 << self.bits) > 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of symbols (b -1: none) their rank, or no_rank."""
        key = (a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)).ravel()
        slot = self._slots(key)
        hit = self.slot_key[slot] == key
        out = np.where(hit, self.slot_rank[slot], self.no_rank)
        left = np.flatnonzero(~hit & self.shared[slot])
        if len(left):
            key = key[left]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            out[left] = np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.no_rank)
        return out.reshape(a.shape)

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Pairs as a dictionary, for the few words that are merged by themselves."""
        told = zip((self.pair_keys >> 32).tolist(), (self.pair_keys & 0xFFFFFFFF).tolist(), self.pair_ranks.tolist(), self.made[self.pair_ranks].tolist())
        return {(a, b): (rank, new) for a, b, rank, new in told}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece: the pair that comes first in the merge list is merged, leftmost first, until none is left."""
        ids = [int(self.single[b]) for b in word]
        if ids:
            ids[-1] = int(self.last[word[-1]])
        if len(ids) > 256:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]))
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]))

    def merge_all(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merge() of many ranges of bytes: their ids in one pool, where those of each start, and how many they are."""
        size = stops - starts
        first, count, pool, made = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [], 0
        for low, high in zip((0, *self.WIDTHS), self.WIDTHS):
            every = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(every), self.BLOCK):
                at = every[k : k + self.BLOCK]
                ids, n = self._merge_block(data, starts[at], size[at], high)
                count[at] = n
                first[at] = made + np.cumsum(n) - n
                pool.append(ids.T[np.arange(high) < n[:, None]])
                made += len(pool[-1])
        for i in np.flatnonzero(size > self.WIDTHS[-1]).tolist():
            ids = self.merge(data[starts[i] : stops[i]].tobytes())
            first[i], count[i] = made, len(ids)
            pool.append(np.array(ids, np.int32))
            made += len(ids)
        return np.concatenate(pool).astype(np.uint32) if pool else np.zeros(0, np.uint32), first, count

    def _merge_block(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of at most `width` bytes, a column each, and how many; in each step every word merges its first best pair."""
        n, total = size.copy(), len(size)
        step = np.arange(width)[:, None]
        bytes_ = data[np.minimum(starts + step, len(data) - 1)]
        ids = np.where(step < n - 1, self.single[bytes_], np.where(step < n, self.last[bytes_], -1))
        rank = np.vstack([self._ranks(ids[:-1], ids[1:]), np.full((1, total), self.no_rank)]).astype(np.int32)
        out, live = np.full((width, total), -1, np.int32), np.arange(total)
        while True:
            best = rank[0] << 6
            for k in range(1, width - 1):
                np.minimum(best, rank[k] << 6 | k, out=best)
            more = best < self.no_rank << 6
            if not more.all():
                out[:, live[~more]] = ids[:, ~more]
                live, ids, rank, best = live[more], ids[:, more], rank[:, more], best[more]
            if not len(live):
                return out, n
            at, column = best & 63, np.arange(len(live))
            # the pair's second symbol goes; what follows moves up
            for k in range(1, width - 1):
                up = at < k
                ids[k] = np.where(up, ids[k + 1], ids[k])
                rank[k] = np.where(up, rank[k + 1], rank[k])
            ids[-1], rank[-2] = -1, self.no_rank
            ids[at, column] = self.made[best >> 6]
            n[live] -= 1
            rank[at, column] = self._ranks(ids[at, column], ids[at + 1, column])
            left = np.flatnonzero(at > 0)
            rank[at[left] - 1, left] = self._ranks(ids[at[left] - 1, left], ids[at[left], left])

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """merge() of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        pool, first, count = self.merge_all(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
        return [pool[a : a + n].tolist() for a, n in zip(first.tolist(), count.tolist())]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, in n log n steps."""
        import heapq

        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = new, True
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [x for x, out in zip(ids, gone) if not out]


class ByteBpe(Merges):
    """The vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None
        #: How byte-level tokenizers split a text (fixed value).
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        vocab = {bytes(byte_of[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = (bytes(byte_of[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        single = [vocab[bytes([b])] for b in range(256)]
        super().__init__(single, single, merges)

    def parts(self, text: str) -> list[str]:
        """A text cut at special tokens: what stands between them and, at odd places, they themselves."""
        return self.marks(text) if self.marks and any(s in text for s in self.special) else [text]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class WordBpe(Merges):
    """The same for a tokenizer file whose words end in a marked symbol."""

    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letter = model["vocab"], _byte_letters()
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        super().__init__([vocab[letter[b]] for b in range(256)], [vocab[letter[b] + self.END] for b in range(256)], merges)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts with a lexicon and, for pieces that it lacks, the merges."""

    def __init__(self, bpe: ByteBpe, lexicon: Lexicon | None):
        self.bpe, self.lexicon = bpe, lexicon
        self.classes, self.cache = byte_classes(), IdCache()
        top = max(bpe.bytes_of) + 1
        self.digits, self.bytes_of = np.empty(top, object), np.empty(top, object)
        for i, b in bpe.bytes_of.items():
            self.digits[i], self.bytes_of[i] = b"%d" % i, b

    def _ids(self, p: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, stops = p.starts[which], p.stops[which]
        rank = self.lexicon.ranks(p.data, starts, stops) if self.lexicon else np.full(len(which), -1)
        unseen, own = np.flatnonzero(rank < 0), np.flatnonzero(rank >= 0)
        pool, first, count = np.zeros(0, np.uint32), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        if len(own):
            at = self.lexicon.starts
            count[own] = at[rank[own] + 1] - at[rank[own]]
            pool = self.lexicon.pool[ranges(at[rank[own]], count[own])]
            first[own] = np.cumsum(count[own]) - count[own]
        more, at, count[unseen] = self.bpe.merge_all(p.data, starts[unseen], stops[unseen])
        first[unseen] = at + len(pool)
        return np.concatenate([pool, more]), first, count

    def encode_texts(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin (and the last end)."""
        special = [pc.match_substring(text, s).to_numpy(zero_copy_only=False) for s in self.bpe.special]
        if not (special and np.any(special)):
            return self._encode_parts(text)
        cut = [self.bpe.parts(t) for t in text.to_pylist()]
        flat, at = self._encode_parts(pa.array([x for own in cut for x in own[::2]], pa.string()))
        n, mark = np.diff(at), [self.bpe.special.get(x, -1) for own in cut for x in [*own[1::2], None]]
        mark = np.array(mark, np.int64)
        size = n + (mark >= 0)
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), np.uint32)
        out[ranges(ends - size, n)] = flat
        out[ends[mark >= 0] - 1] = mark[mark >= 0]
        return out, np.r_[0, ends][np.r_[0, np.cumsum([len(own) // 2 + 1 for own in cut])]]

    def _encode_parts(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        p = byte_pieces(text, self.classes)
        flat, at = self.cache.ids(self.cache.entries(p, self._ids))
        return flat, at[p.first]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()


# --- over tables


def count_words(docs: DataFrame) -> DataFrame:
    """word (as a piece after a space, binary) and how often it occurs in all texts."""

    @tidy
    def run(batches):
        seen: Counter[bytes] = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in raw_texts(batch.column(0)):
                if t:
                    seen.update(t.split())
                if len(seen) > 400_000:
                    yield told()
        if seen:
            yield told()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words, `limit` at most, the most frequent first.

    A histogram of the counts (to three digits, so of bounded size) gives the least count with which no more than `limit`
    words are left; only those are collected. Words of one step of the histogram are taken or left together."""
    scratch = Scratch(docs.sparkSession, "words")
    counted = scratch.save(count_words(docs).where(F.octet_length("word") < WORD_BYTES), "counts")
    unit = F.pow(F.lit(10), F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))).cast("long")
    step = (F.col("n") - F.col("n") % unit).alias("step")
    least, taken = None, 0
    for r in sorted(counted.groupBy(step).count().collect(), reverse=True):
        taken += r["count"]
        if taken > limit:
            break
        least = r.step
    rows = [] if least is None else counted.where(F.col("n") >= least).collect()
    scratch.drop(counted)
    return [bytes(r.word) for r in sorted(rows, key=lambda r: (-r.n, bytes(r.word)))]


def build_lexicon(words: list[bytes], bpe: ByteBpe, limit: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the pieces of such words, each after a space, the most frequent first."""
    pieces: dict[bytes, None] = {}
    for w in words:
        for piece in bpe.pieces(" " + w.decode(errors="ignore")):
            raw = piece.encode()
            if 0 < len(raw) <= WORD_BYTES:
                pieces.setdefault(raw)
        if len(pieces) >= limit:
            break
    chosen = list(pieces)[:limit]
    return compile_lexicon(zip(chosen, bpe.merge_words(chosen)))


def share_file(spark: SparkSession, data: bytes, kind: str) -> str:
    """The name of a file with these bytes that SparkFiles.get() finds on each executor."""
    name = f"{kind}-{hashlib.sha256(data).hexdigest()[:24]}"
    if name not in {x.rsplit("/", 1)[-1] for x in spark.sparkContext.listFiles}:
        fs, p = hadoop_fs(spark, f"{Scratch(spark, 'files').root}/{name}")  # goes when the session's process ends
        stream = fs.create(p, True)
        stream.write(bytearray(data))
        stream.close()
        spark.sparkContext.addFile(fs.makeQualified(p).toString())
    return name


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False, limit: int = LEXICON_WORDS) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    spark = docs.sparkSession
    name = share_file(spark, build_lexicon(frequent_words(docs, limit), ByteBpe(tokenizer), limit), "lexicon")

    def digest(part: pa.RecordBatch, text: pa.StringArray) -> pa.RecordBatch:
        encoder = kept("encoder", lambda: Encoder(ByteBpe(tokenizer), Lexicon.open(SparkFiles.get(name))))
        flat, at = encoder.encode_texts(text)
        told, back = encoder.digits[flat].tolist(), encoder.bytes_of[flat].tolist()
        sums, decoded = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            sums.append(hashlib.sha256(b",".join(told[a:b])).hexdigest())
            decoded.append(hashlib.sha256(b"".join(back[a:b]).decode(errors="replace").encode()).hexdigest())
        columns = [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(over_chunks(digest, limit=2 << 20), shape)
