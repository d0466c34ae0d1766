"""Plain versions that the operators are held against, and odd inputs for all of them."""

import hashlib
import random

ODD_TEXTS = [None, "", "   \n\t ", "one", "a b c", "x " * 30, "\n\n\n", "é\xa0ü ß\x85y", "same line\nsame line\nsame line\nsame line\nsame line", "w" * 5000]


def corpus(n=60, seed=2):
    """Texts that share words, lines and passages, with copies and near copies."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "And", "tion", "é", "ß", "||", "a*b", "Mit", "License"] + [f"w{i}" for i in range(30)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12)))
    passages = ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.2:
            out.append(r.choice(out))
        elif out and kind < 0.4:
            words = r.choice(out).split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append("\n".join(r.choice(passages) if r.random() < 0.4 else line() for _ in range(r.randint(1, 9))))
    return out


def rows(seed=2, n=60):
    """(doc_id, text): ids out of order, one of them twice, one null."""
    texts = [*corpus(n, seed), *ODD_TEXTS]
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    out = list(zip(ids, texts))
    return [*out, out[0], out[5]]


def frame(spark, data):
    """A documents table with further columns, some named as an operator's own."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, h int, place int, n_words string"
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t), "k", 1, 2, 3, "n") for i, t in data], shape)


def words(text):
    return (text or "").encode().split()


def substring(data, window=13):
    """(doc_id, n_words, n_removed, kept_sha256)"""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in data:
        w = words(t)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for i, t in data:
        w = words(t)
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < key(i):
                gone |= set(range(a, a + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def shingle_set(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(data, percent, k):
    """(doc_id, n_shingles, component_id)"""
    sets = [shingle_set(t, k) for _, t in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets))), key=repr)
