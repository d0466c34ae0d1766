"""Operators that look at one text at a time, at lines, or at pages, against plain versions."""

import hashlib
import random
import re

import pytest

from ledgerlake.llm import fingerprints, licenses, linededup, quality, warc

from . import plain


def line_dedup(data, size=3):
    blanks = " \t\r\x0b\x0c"
    docs = sorted({(i is not None, i or 0, t or "") for i, t in data})
    # rows of one id are ordered by the hash of their text; the tests below keep ids of different texts apart
    first, solid = {}, {}
    for d in docs:
        lines = d[2].split("\n")
        solid[d] = [(n, x.strip(blanks)) for n, x in enumerate(lines) if x.strip(blanks)]
        for a in range(len(solid[d]) - size + 1):
            first.setdefault(tuple(x for _, x in solid[d][a : a + size]), (d, a))
    out = {}
    for d in docs:
        own, gone = solid[d], set()
        for a in range(len(own) - size + 1):
            if first[tuple(x for _, x in own[a : a + size])] != (d, a):
                gone |= set(range(a, a + size))
        lines, cut = d[2].split("\n"), set()
        for j in gone:
            cut.add(own[j][0])
            if j + 1 in gone:
                cut |= set(range(own[j][0], own[j + 1][0]))
        out[d] = (len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in cut))
    return sorted(((i, *out[(i is not None, i or 0, t or "")]) for i, t in data), key=repr)


@pytest.mark.parametrize("seed", [3, 8])
def test_line_dedup_matches_plain_version(spark, seed):
    data = [*plain.rows(seed), (None, "a\nb\nc\nd"), (900, "a\n\nb\n c \n\nd\ne"), (901, "x\na\nb\nc\nx\nc\nd\ne")]
    df = plain.frame(spark, data)
    out = linededup.dedup_lines(df)
    assert set(df.columns) <= set(out.columns)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()), key=repr) == line_dedup(data)
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_leaves_other_columns_alone(spark):
    inner = ["n_lines", "n_removed", "spans", "row", "id", "hash", "lines", "at", "runs", "_id", "_runs", "key", "h", "text_hash", "start", "stop", "run1", "run2", "fingerprint", "around", "a.b"]
    data = [(i, t) for i, t in plain.rows(6, 30)]
    df = spark.createDataFrame([(i, t, *(f"{c}{k}" for c in inner)) for k, (i, t) in enumerate(data)], ["doc_id", "text", *inner])
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *inner, "n_lines_", "n_removed_", "spans_"]
    assert sorted(((r.doc_id, r.n_lines_, r.n_removed_, r.text) for r in out.collect()), key=repr) == line_dedup(data)
    kept = {(r[0], tuple(r[2:])) for r in linededup.dedup_documents(df).collect()}
    assert kept <= {(r[0], tuple(r[2:])) for r in df.collect()} and linededup.dedup_documents(df).columns == df.columns
    empty = spark.createDataFrame([], df.schema)
    assert linededup.dedup_lines(empty).collect() == [] and linededup.dedup_documents(empty).collect() == []


def test_line_dedup_drops_texts_that_lost_all(spark):
    df = plain.frame(spark, [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "q\na\nb\nc\n"), (4, ""), (5, None)])
    out = {r.doc_id: r for r in linededup.dedup_documents(df).collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[3].text == "q\n" and out[3].n_chars == 2


def test_short_repeats_count_on_request(spark):
    long = " ".join(f"w{i}" for i in range(50))
    near = " ".join(f"w{i}" for i in range(49))
    data = [(1, "a\nb"), (2, "a\n\n b \n"), (3, f"a\n{long}\nz"), (4, f"q\n{long}\nr\n{long}"), (5, near), (6, f"{near}\nx"), (7, "a"), (8, "a\nb\nc"), (9, "p\na\nb\nc"), (10, None), (None, "k"), (11, "k"), (12, long), (13, f"{long}\na\nb\nc")]
    df = plain.frame(spark, data)
    got = {r.doc_id: (r.n_removed, r.text, [tuple(x) for x in r.spans]) for r in linededup.dedup_lines(df, short_words=50).collect()}
    want = {i: (0, t or "", []) for i, t in data}
    want |= {2: (2, "", [(0, 3)]), 4: (2, "q\nr", [(1, 2), (3, 4)]), 9: (3, "p", [(1, 4)]), 11: (1, "", [(0, 1)]), 12: (1, "", [(0, 1)]), 13: (4, "", [(0, 4)])}
    want[2] = (2, "\n".join(["a", "", " b ", ""][3:]), [(0, 3)])
    assert got == want
    assert {r.doc_id for r in linededup.dedup_documents(df, short_words=50).collect()} == {i for i, _ in data} - {2, 11, 12, 13}
    # off unless asked for: the query's SQL has runs only
    assert {r.doc_id for r in linededup.dedup_lines(df).collect() if r.n_removed} == {9, 13}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_scan_matches_plain_version(spark):
    r = random.Random(4)
    notices = [t.notice.replace(" ", s) for t in licenses.TEMPLATES for s in (" ", "-", "\n")]
    texts = [*plain.ODD_TEXTS, "CC BY-NC 4.0", "cc by cc by", "mit mit license license", "worK CC BY", "mit", "GNU general public LICENSE, version 3."]
    texts += [" ".join(r.choice([*notices, "the", "of", "mit", "license", "gnu", "é"]) for _ in range(r.randint(1, 9))) for _ in range(80)]
    data = [*enumerate(texts), (None, texts[20]), (3, texts[3])]
    got = {}
    for row in licenses.scan(plain.frame(spark, data)).collect():
        got.setdefault(row.doc_id, []).append(row)
    for i, t in data:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places, score = [], 0.0
        for x in licenses.TEMPLATES:
            key = x.key.split()
            for a in range(len(w)):
                if w[a : a + len(key)] == key:
                    places.append((x.label, x.base, a))
                    at = a - x.offset
                    score = max(score, sum(0 <= at + j < len(w) and w[at + j] == v for j, v in enumerate(x.words)) / len(x.words))
        base = [p for p in places if p[1]]
        for row in got[i]:
            assert (row.n_words, row.n_base) == (len(w), len(base))
            assert (row.first_word, row.last_word) == ((min(p[2] for p in base), max(p[2] for p in base)) if base else (None, None))
            assert row.base_labels == ",".join(sorted({p[0] for p in base})) and row.labels == ",".join(sorted({p[0] for p in places})) and row.score == pytest.approx(score)
    assert licenses.scan(plain.frame(spark, data).limit(0)).collect() == []
    long = spark.createDataFrame([(1, "MIT License the of " * 30_000), (2, "x " * 200_000 + "Licensed under CC BY")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.score) for r in licenses.scan(long).collect()) == [(1, 120_000, 30_000, 0, 119_996, 0.4), (2, 200_004, 1, 200_002, 200_002, 1.0)]


def counts(t):
    t = t or ""
    w = plain.words(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1}
    cover = {i + j for i, x in enumerate(windows) if x in many for j in range(3)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if plain.words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_counts_match_plain_version(spark):
    data = [*plain.rows(5), (700, "a b c a b c " * 20), (701, "one two\none two\n\n\none two"), (702, "ä" * 60 + " b")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(plain.frame(spark, data)).collect()), key=repr)
    assert got == sorted(((i, *counts(t)) for i, t in data), key=repr)


def test_binomial_bounds():
    from math import comb

    for n, p in ((10, 0.3), (57, 0.02)):
        for x in range(n + 1):
            want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
            assert quality.log_binom_cdf(x, n, p) == pytest.approx(__import__("math").log(want), abs=1e-9)
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9) and quality.upper_bound(5, 5, 0.1) == 1


def test_cutoffs_keep_the_promise_and_reject_junk(spark):
    r = random.Random(6)
    clean = lambda: " ".join(r.choice("abcdefghij") * r.randint(2, 7) for _ in range(80))
    junk = lambda: " ".join(r.choice("abcdefghij") * 4 + "%%%" for _ in range(80))
    data = [(i, clean() if i % 5 else junk()) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, _ in data[:5000]] + [(None, 1, 0), (0, 0, 0), (7, 5, 1)], "doc_id long, quality int, toxic int")
    df = plain.frame(spark, data)
    kept = {x.doc_id: x.kept for x in quality.assess(df, labels).collect()}
    assert not any(kept[i] for i, _ in data if i % 5 == 0)
    good = [i for i, _ in data if i % 5 and i != 3]
    assert sum(not kept[i] for i in good) <= quality.Risk().alpha * len(good)
    passed = quality.filter_documents(df, labels)
    assert passed.columns == df.columns and {x.doc_id for x in passed.collect()} == {i for i, k in kept.items() if k}
    # too few labels certify nothing: all that pass the base rules are kept
    base = {i for i, t in data if (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    for few in (labels.limit(50), labels.limit(0)):
        assert {x.doc_id for x in quality.filter_documents(df, few).collect()} == base
    assert quality.assess(df.limit(0), labels).collect() == []


def plain_verdicts(data, labels, half_of, risk):
    """kept of each row of data (doc_id, text, lang), by exact sums of the binomial distribution; half_of: the half of each labelled id."""
    from fractions import Fraction
    from math import comb

    def features(t):
        w, t = plain.words(t), t or ""
        chars, (n, _, symbols, dup, repeat) = sum(len(x.decode()) for x in w), counts(t)
        over = lambda a, b: a / max(b, 1)
        lines = sum(bool(plain.words(x)) for x in t.split("\n"))
        return {"symbols": over(symbols, chars), "repeated_lines": over(dup, lines), "repeated_words": over(repeat, n), "capitals": over(sum("A" <= c <= "Z" for c in t), chars), "marks": over(sum(c in "!?" for c in t), n), "long_words": over(chars, n)}

    base = lambda t: (c := counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]
    good = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            good[i] = min(q, good.get(i, 1))
    trial = {}  # one row an id
    for i, t, lang in data:
        if i in good and not base(t):
            trial.setdefault(i, (lang or "und", features(t), good[i], half_of[i]))
    strata = {s for s, _, _, _ in trial.values()}
    error, share = Fraction(risk.delta) / (len(strata) * len(quality.RULES)), Fraction(risk.alpha) / len(quality.RULES)
    cut = {}
    for s in strata:
        own = [x for x in trial.values() if x[0] == s]
        for rule, (_, _, grid) in quality.RULES.items():
            lost = lambda half, q, c: sum(f[rule] > c for _, f, g, h in own if g == q and h == half)  # noqa: B023, E731
            n, best = sum(g == 1 and h == 1 for _, _, g, h in own), 0
            for c in grid:
                if not n or sum(comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(lost(1, 1, c) + 1)) > error:
                    break
                worth = lost(0, 0, c) - risk.penalty * lost(0, 1, c)
                if worth > best:
                    best, cut[s, rule] = worth, c
    return [not base(t) and not any(f > cut.get((lang or "und", rule), 9e9) for rule, f in features(t).items()) for _, t, lang in data], cut


def test_verdicts_match_plain_version(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdefghij") * r.randint(2, 7)
    kinds = {
        "clean": lambda: " ".join(word() for _ in range(60)),
        "symbols": lambda: " ".join(word() + "%%" * r.randint(0, 2) for _ in range(60)),
        "marks": lambda: " ".join(word() + "!" * r.randint(0, 2) for _ in range(60)),
        "loud": lambda: " ".join(word().upper() for _ in range(60)),
    }
    data, labels = [], []
    for i in range(1600):
        lang = ("en", "fr", "de", None)[i % 4]
        kind = r.choice(["clean"] * 6 + ["symbols", "marks", "loud"])
        data.append((i, kinds[kind](), lang))
        if i < 1500:
            # loud texts are good in "fr", and "de" has few labels
            labels += [(i, int(kind == "clean" or kind == "loud" and lang == "fr"))] * (lang != "de" or i < 40)
    data += [(0, data[0][1], "en"), (3, None, None), (None, data[1][1], "fr"), (1599, "", "en")] + [(8, data[8][1], "en")] * 50
    labels += [(None, 1), (4, 0), (9, 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    halves = {x.doc_id: x.half for x in docs.where("doc_id is not null").selectExpr("doc_id", "cast(pmod(xxhash64(doc_id, 17), 2) as int) as half").distinct().collect()}
    risk = quality.Risk(alpha=0.3, delta=0.2, penalty=2.0)
    want, cut = plain_verdicts(data, labels, halves, risk)
    got = quality.assess(docs, told, risk).select("doc_id", "stratum", "kept").collect()
    assert len({s for s, _ in cut}) >= 2 and not all(want)
    lang_of = lambda x: x or "und"
    assert sorted(map(tuple, got), key=repr) == sorted(((i, lang_of(lang), k) for (i, _, lang), k in zip(data, want)), key=repr)
    kept = quality.filter_documents(docs, told, risk)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((x for x, k in zip(data, want) if k), key=repr)


def test_filter_works_on_any_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "s", 2), (None, "short", "t", 3)], ["doc_id", "text", "_stratum", "stratum"])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(x) for x in quality.filter_documents(df, labels).collect()] == [(1, text, "s", 2)] and quality.filter_documents(df.limit(0), labels).collect() == []


def test_each_of_many_strata_is_certified_by_itself(spark):
    import numpy as np
    from pyspark.sql import functions as F

    # 300 larger strata and 500 smaller ones, which have many labels together; in the stratum "odd" good texts look like bad ones
    part = lambda n, start, stratum, good, symbols: spark.range(start, start + n).select(F.col("id").alias("doc_id"), stratum.alias("stratum"), good.cast("int").alias("good"), symbols.cast("long").alias("n_symbols"))
    one, bad = F.lit(1), F.col("id") % 5 == 0
    junk = F.when(bad, 400).otherwise(0)
    rows = part(300 * 30, 0, F.concat(F.lit("big"), F.col("id") % 300), one, F.lit(0))
    rows = rows.union(part(500 * 20, 20000, F.concat(F.lit("small"), F.col("id") % 499), F.when(bad, 0).otherwise(1), junk)).union(part(20, 40000, F.lit("odd"), one, F.lit(400)))
    rows = rows.union(part(20000, 50000, F.lit("en"), F.when(bad, 0).otherwise(1), junk))
    zero = [F.lit(0).cast("long").alias(c) for c in quality.COUNTS if c not in ("n_words", "n_symbols", "word_chars")]
    found = rows.select("doc_id", "stratum", "n_symbols", F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"), *zero)
    cutoffs = quality.fit(found, rows.selectExpr("doc_id", "good as quality"))
    assert set(cutoffs) == {"en"} and "symbols" in cutoffs["en"]
    strata = ["odd", "big1", "without labels", "en"]
    c = {k: np.full(4, {"n_words": 100, "n_symbols": 400, "word_chars": 500}.get(k, 0)) for k in quality.COUNTS}
    assert quality.passes(c, strata, cutoffs).tolist() == [True, True, True, False]


def test_fixed_sequence_stops_at_the_first_failure():
    grid = quality.RULES["symbols"][2]
    rows = [("en", "symbols", h, 1, 0, 5000) for h in (0, 1)] + [("en", "symbols", 0, 0, len(grid), 500), ("en", "symbols", 1, 1, 6, 900)]
    cut = quality.select_cutoffs(rows)["en"]["symbols"]
    assert cut == grid[0]  # all equal in worth: the mildest
    rows[2:3] = [("en", "symbols", 0, 0, 3, 500)]  # only the three strictest cutoffs would reject the bad ones, and those lose 900 of 5900
    assert "en" not in quality.select_cutoffs(rows)


def plain_print(t, how):
    """The fingerprint of a text, a bin at a time: only the hash of a shingle is taken from the library."""
    import numpy as np
    import pyarrow as pa

    from ledgerlake.llm.textvec import U, mix, shingle_sets, words

    items = shingle_sets(words(pa.array([t])), how.words)[0].tolist()
    if not items:
        return []
    width = 64 - (how.bins - 1).bit_length()
    least = {}
    for x in items:
        least[x >> width] = min(least.get(x >> width, 1 << 64), x & ((1 << width) - 1))
    low = lambda v: int(mix(np.array([v], U))[0])
    out = []
    for i in range(how.bins):
        attempt, at = 0, i
        while at not in least:
            attempt += 1
            at = low((i * 0x9E3779B97F4A7C15 + attempt * 0xC2B2AE3D27D4EB4F) % 2**64) % how.bins
        out.append(low(least[at]) & ((1 << how.bits) - 1))
    return out


def plain_pack(values, how):
    each = 8 // how.bits
    return bytes(sum(v << (k * how.bits) for k, v in enumerate(values[a : a + each])) for a in range(0, len(values), each)).hex()


def plain_likeness(p, q, how):
    if not p or not q:
        return float(p == q)
    same, chance = sum(a == b for a, b in zip(p, q)) / how.bins, 2.0**-how.bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited_pairs(spark, data, how):
    told = spark.createDataFrame([(i, t or "") for i, t in data], "id long, t string").selectExpr("id", "t", "xxhash64(t) as h").collect()
    order = sorted(told, key=lambda r: (r.id is None, -(r.id or 0), r.h))
    out = []
    for a, b in zip(order, order[1:] + order[:1]):
        n = len(a.t)
        edited = a.t[: n - n // 2] + b.t[: n // 2]
        p, e, q = (plain_print(x, how) for x in (a.t, edited, b.t))
        out.append((a.id, n, hashlib.sha256(edited.encode()).hexdigest(), plain_pack(p, how), plain_pack(e, how), pytest.approx(plain_likeness(p, e, how)), pytest.approx(plain_likeness(p, q, how))))
    return out


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_fingerprints_match_plain_version(spark, monkeypatch, parts):
    monkeypatch.setattr(fingerprints, "partitions", lambda docs, factor: parts)
    how = fingerprints.MinHash(bins=64)
    data = [*plain.rows(9, 40), (-(1 << 63), "a b c d e f g h"), ((1 << 63) - 1, "b c d e f g h i j"), (None, "x y z"), (None, None), (None, "1 2 3 4 5 6 7"), *((None, f"n{i} a b c d e") for i in range(20)), *((5, f"m{i} c b c d e f") for i in range(20))]
    rows = [tuple(r) for r in fingerprints.edited_pairs(plain.frame(spark, data), how).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(rows, key=key) == sorted(edited_pairs(spark, data, how), key=key)


def test_fingerprints_of_few_rows(spark):
    how = fingerprints.MinHash()
    df = plain.frame(spark, plain.rows(9, 9))
    assert fingerprints.edited_pairs(df.limit(0)).collect() == []
    alone = fingerprints.edited_pairs(plain.frame(spark, [(4, "a b c d e f")])).collect()
    assert [(r.doc_id, r.edited_sha256) for r in alone] == [(4, hashlib.sha256(b"a b c a b c"[:11][:6] + b"a b c").hexdigest())]
    assert len({r.fingerprint for r in fingerprints.edited_pairs(plain.frame(spark, [(None, "q w e r t y")] * 5)).collect()}) == 1
    assert how.pack([]) == []
    # null ids, or one id, in most rows are dealt out to several ranges
    many = spark.range(3000).selectExpr("cast(if(id % 3 = 0, id, null) as long) as id", "concat('t', id) as text", "xxhash64(concat('t', id)) as hash")
    assert fingerprints.order_of(many, 30).count >= 30 and len(fingerprints.order_of(many, 30).nulls) >= 15
    one = many.selectExpr("cast(7 as long) as id", "text", "hash")
    assert len(fingerprints.order_of(one, 30).ids) >= 29


def test_likeness_of_edited_texts(spark):
    data = [(i, t) for i, t in enumerate(plain.corpus(60, 4))]
    for r in fingerprints.edited_pairs(plain.frame(spark, data)).collect():
        t, u = data[r.doc_id][1], data[(r.doc_id - 1) % len(data)][1]
        a, b = plain_set(t), plain_set(t[: len(t) - len(t) // 2] + u[: len(t) // 2])
        true = len(a & b) / len(a | b) if a or b else 1.0
        assert abs(r.near_edited - true) < 0.2 and (r.near_edited == 1.0 or a != b)


def plain_set(t, k=5):
    w = plain.words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_likeness_is_unbiased():
    import numpy as np

    from ledgerlake.llm.textvec import U, mix

    how, r = fingerprints.MinHash(), np.random.default_rng(2)
    for true in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(60):
            n = int(r.integers(40, 3000))
            both = round(2 * n * true / (1 + true))
            x = mix(r.integers(1, 1 << 62, 2 * n - both).astype(U))
            p, q = how.pack([x[:n], x[n - both :]])
            errors.append(how.likeness([p], [q])[0] - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03


def test_warc_records_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/é", '<html lang="EN"><head><title>A &amp; B</title><style>x{}</style></head><body><p>One&nbsp;&lt;two&gt;<br>three<!-- no --><script>var t="</p>";</script></p><a href="/x">y</a></body></html>', "z"), (2, None, None, "z"), (2, None, None, "z"), (None, "u", "plain &amp;lt; text", "z")], "page_id long, url string, html string, block string")
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages), ("page_id",)).collect()
    assert len(rows) == 8
    for r in rows:
        s = source[r.refers_to]
        assert (r.target_uri, r.date, r.source_payload_digest) == (s.target_uri, s.date, s.payload_digest) and r.record_id != r.refers_to
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    said = {(r.page_id, r.record_type): r.block for r in rows}
    assert said[1, "conversion"] == "A & B\nOne <two>\nthree\ny" and said[2, "conversion"] == "" and said[None, "conversion"] == "plain &lt; text"
    meta = dict(x.split(": ", 1) for x in said[1, "metadata"].strip().split("\r\n"))
    assert (meta["title"], meta["language"], meta["outlinks"], meta["http-status"]) == ("A & B", "en", "1", "200")
    whole = warc.derivatives(warc.responses(pages))
    text = whole.select(warc.serialized(whole).alias("t")).collect()
    assert all(r.t.startswith("WARC/1.1\r\nWARC-Type: ") and "\r\nWARC-Refers-To: <urn:uuid:" in r.t for r in text)


def test_warc_pages_that_are_broken_long_or_absent(spark):
    import time

    n = 1 << 17
    odd = ["<!-- x " * n, "a < b " * n, "<p" * n, "<script>" * n, "<title>" * n, "one <b>two</b> < three", "x<!-- open <p>gone</p>", "y<svg><p>gone", "<p>1</p> < 2 > 3 < 4"]
    pages = spark.createDataFrame([(i, f"http://a/{i}", t, "mine", "theirs") for i, t in enumerate(odd)], "page_id long, url string, html string, block string, record_id string")
    began = time.time()
    rows = warc.derivatives(warc.responses(pages), ("page_id",)).where("record_type = 'conversion'").collect()
    assert time.time() - began < 60
    got = {r.page_id: r.block for r in rows}
    assert got[0] == "" and got[1] == "a < b " * (n - 1) + "a < b" and got[5] == "one two < three" and got[6] == "x" and got[7] == "y" and got[8] == "1\n3 < 4"
    clash = warc.responses(pages).join(pages.select("page_id", "block"), "page_id")
    out = warc.derivatives(clash, ("page_id", "block", "record_id"))
    assert {(r.block_, r.record_type) for r in out.where("page_id = 5").collect()} == {("mine", "metadata"), ("mine", "conversion")}
    assert out.where("record_id_ = refers_to").count() == 2 * len(odd)
    assert warc.derivatives(warc.responses(pages.limit(0)), ("page_id",)).collect() == []


def test_warc_metadata_keeps_every_source_header(spark):
    heads = "HTTP/1.1 404 Not Found\r\nServer: a: b\r\nContent-Type: text/html\r\nLast-Modified: Mon, 1 Jan\r\n 2024\r\nSet-Cookie: x=1\r\nset-cookie: y=2\r\nX-Empty:\r\n\r\n"
    data = [("<urn:a>", heads), ("<urn:b>", "HTTP/1.0 200\nContent-Language: fr\n\n"), ("<urn:c>", None)]
    df = spark.createDataFrame([(i, "http://a", "d", h, "<p>x</p>", "sha256:0") for i, h in data], "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string")
    meta = {r.refers_to: [x for x in r.block.split("\r\n") if x.startswith("http-")] for r in warc.derivatives(df).where("record_type = 'metadata'").collect()}
    assert meta == {
        "<urn:a>": ["http-status: 404", "http-server: a: b", "http-content-type: text/html", "http-last-modified: Mon, 1 Jan 2024", "http-set-cookie: x=1", "http-set-cookie: y=2", "http-x-empty: "],
        "<urn:b>": ["http-status: 200", "http-content-type: ", "http-content-language: fr"],
        "<urn:c>": ["http-status: ", "http-content-type: "],
    }
