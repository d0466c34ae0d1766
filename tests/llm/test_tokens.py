"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "\n\n  x\t", "it's  DON'T we'll", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d x\x85y z\xa0", "é́ 日本語テキスト 🙂🙂 ½²", "1234 5,678.90", "x" * 700, "ab" * 400, "​​ ", "İstanbul ΑΣ Σ", "<|startoftext|>q", "é ́a"]


@pytest.fixture(scope="module")
def byte():
    return bpe.ByteBpe(BYTE)


def noise(n, seed=5):
    r = random.Random(seed)
    letters = "abc de  \n\t'.,!?<|>sStT01²é ßñ日 \x1f\x85🙂"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(n)]


def test_merges_match_the_library(byte):
    ref = Tokenizer.from_file(BYTE)
    encoder = bpe.Encoder(byte, None)
    for t in ODD + noise(800):
        want = ref.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == want, t
        assert byte.decode(want).decode(errors="replace") == ref.decode(want, skip_special_tokens=False)


def test_texts_together_encode_as_each_by_itself(byte):
    for path, encoder in ((BYTE, bpe.Encoder(byte, None)), (WORD, packing.WordEncoder(WORD))):
        ref = Tokenizer.from_file(path)
        texts = ["", *ODD, "it'S 's 'll 're a'res ''s '", "DON'T", "'s", "x 's", "", " ", "Où ÉTÉ × Þ÷ÿ's", *noise(900, 8), ""]
        encode = getattr(encoder, "encode_texts", encoder.encode)
        for _ in range(2):  # the second time from memory
            flat, at = encode(pa.array(texts, pa.string()))
            for t, a, b in zip(texts, at[:-1], at[1:]):
                assert flat[a:b].tolist() == ref.encode(t, add_special_tokens=False).ids, t


def test_memory_of_pieces_is_bounded_and_exact(byte, monkeypatch):
    from ledgerlake.llm import pieces

    ref = Tokenizer.from_file(BYTE)
    encoder = bpe.Encoder(byte, None)
    encoder.cache = pieces.IdCache(limit=20_000)
    r = random.Random(4)
    for k in range(12):
        texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(60)) for _ in range(5)]
        flat, at = encoder.encode_texts(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [ref.encode(t, add_special_tokens=False).ids for t in texts]
        assert k < 2 or len(encoder.cache.keys) < 600
    # pieces whose hashes are equal are told apart by their bytes
    monkeypatch.setattr(pieces, "hash_ranges", lambda data, starts, stops: (stops - starts).astype(np.uint64) % np.uint64(3))
    encoder.cache = pieces.IdCache()
    for _ in range(2):
        flat, at = encoder.encode_texts(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [ref.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_merge_as_short_ones(byte):
    r = random.Random(1)
    for n in (300, 999):
        w = "".join(r.choice("aAeEnst") for _ in range(n)).encode()
        ids = [int(byte.single[b]) for b in w]
        assert byte.decode(byte._merge_long(list(ids))) == w
        assert byte._merge_long(list(ids)) == Tokenizer.from_file(BYTE).encode(w.decode(), add_special_tokens=False).ids


def test_lexicon_is_exact_and_minimal():
    words = {f"{a}{b}tion".encode(): [i, i + 1] for i, (a, b) in enumerate((x, y) for x in "abcdef" for y in ("re", "na", ""))}
    data = bpe.compile_lexicon(words.items())
    lex = bpe.Lexicon(data)

    def ranks(lexicon, asked):
        ends = np.cumsum([len(w) for w in asked])
        return lexicon.ranks(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], ends).tolist()

    assert {w: lex.ids(r) for w, r in zip(words, ranks(lex, list(words)))} == words
    assert ranks(lex, [b"", b"a", b"ation", b"ationn", b"zz", b"x" * 99])[2] >= 0
    assert [x < 0 for x in ranks(lex, [b"", b"a", b"ationn", b"zz", b"x" * 99])] == [True] * 5
    # all words share one path for "tion", and all first letters one state after it
    assert len(lex.final) == 1 + 1 + 2 + 1 + 4
    assert ranks(bpe.Lexicon(bpe.compile_lexicon([])), [b"a"]) == [-1]


def test_documents_encode_as_the_library(spark):
    ref = Tokenizer.from_file(BYTE)
    texts = [None, *ODD, *noise(60)]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string")
    got = sorted(map(tuple, bpe.encode_documents(df, BYTE).collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((i if i else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(df.limit(0), BYTE).collect() == []


def test_frequent_words(spark):
    df = spark.createDataFrame([(1, "a a a b b c"), (2, None), (3, "b a d\n"), (4, "e" * 60)], "doc_id long, text string")
    assert bpe.frequent_words(df, 2) == [b"a", b"b"] and bpe.frequent_words(df, 3) == [b"a", b"b"]
    assert bpe.frequent_words(df, 9) == [b"a", b"b", b"c", b"d"] and bpe.frequent_words(df, 0) == []


def test_plan_is_gapless_and_tight():
    r = random.Random(3)
    for size in (7, 64, 2048):
        for _ in range(30):
            hist = {r.randint(1, size): r.randint(1, 50) for _ in range(r.randint(1, 40))}
            at, ranks = {}, {}
            for run in packing.plan(hist, size):
                assert ranks.get(run.length, 0) == run.first_rank
                ranks[run.length] = run.first_rank + run.count
                for i in range(run.count):
                    at.setdefault(run.sequence + i // run.per_sequence, []).append((run.offset + i % run.per_sequence * run.length, run.length))
            assert ranks == hist
            for slots in at.values():
                slots.sort()
                assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= size
            total = sum(k * n for k, n in hist.items())
            items = sorted((k for k, n in hist.items() for _ in range(n)), reverse=True)
            bins = []
            for x in items:
                fit = [b for b in bins if b[0] >= x]
                if fit:
                    min(fit)[0] -= x
                else:
                    bins.append([size - x])
            assert -(-total // size) <= len(at) <= len(bins)


def test_packing_matches_the_library(spark, sf):
    ref = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, *ODD, *noise(80, 9)])], "doc_id long, text string")
    both = docs.unionByName(more)
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    rows = packing.pack(both, WORD).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for doc, text in texts.items():
        ids = [*ref.encode(text, add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(by[doc], key=lambda r: r.piece)):
            own = ids[k * 2048 : (k + 1) * 2048]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * 2048, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)))
        assert len(by[doc]) == -(-len(ids) // 2048)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= 2048
    assert packing.pack(docs.limit(0), WORD).collect() == []
