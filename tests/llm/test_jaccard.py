import itertools
import random

import numpy as np
import pytest

from ledgerlake.llm import jaccard
from ledgerlake.llm.textvec import U, mix

from . import plain


def told(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature_and_pass_the_sketch(percent):
    r = np.random.default_rng(percent)
    sim = jaccard.Similarity(percent)
    shared = 0
    for _ in range(600):
        n = int(r.integers(1, 300))
        base = mix(r.integers(1, 1 << 62, n).astype(U))
        cut = int(r.integers(0, n // 6 + 1))
        other = np.unique(np.r_[base[cut:], mix(r.integers(1, 1 << 62, int(r.integers(0, n // 6 + 1))).astype(U))])
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        if len(other) and 100 * both >= percent * (len(base) + len(other) - both) and len(base) + len(other) > 2 * both:
            shared += 1
            assert np.intersect1d(jaccard.signatures(base, sim), jaccard.signatures(other, sim)).size
            p, q = jaccard.sketch(base, sim), jaccard.sketch(other, sim)
            size = min(len(p), len(q))
            differ = np.bitwise_count(jaccard._folded(p, size) ^ jaccard._folded(q, size)).sum()
            assert differ <= len(base) + len(other) - 2 * both
            assert jaccard.may_link(np.array([len(base)]), np.array([len(other)]), np.array([differ]), sim).all()
    assert shared > 50


@pytest.mark.parametrize("percent,k,block,nearest", [(80, 5, 1024, 4), (90, 3, 1024, 1), (80, 2, 3, 1)])
def test_matches_plain_version(spark, monkeypatch, percent, k, block, nearest):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    monkeypatch.setattr(jaccard, "LONGER", 2)
    data = plain.rows(percent, 50)
    r = random.Random(k)
    base = [f"t{i}" for i in range(120)]
    for i in range(25):  # a group whose links form chains
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"z{r.randrange(50)}"
        data.append((1000 + i, " ".join(w)))
    data += [(None, " ".join(base)), (None, "alone " * 3)]
    assert told(jaccard.join_classes(plain.frame(spark, data), jaccard.Similarity(percent, k))) == plain.classes(data, percent, k)


def test_keeps_one_and_empty_table(spark):
    base = " ".join(f"t{i}" for i in range(90))
    df = plain.frame(spark, [(5, base), (3, base), (9, base + " more"), (7, "other"), (8, ""), (6, None), (None, base)])
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [3, 6, 7, 8]
    assert jaccard.join_classes(df.limit(0), jaccard.Similarity()).collect() == []


def test_keeps_one_row_of_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(90))
    a, b, c, d, e = map(text, "abcde")
    # an id twice with one text; null ids that are near copies; an id with two texts, one of them linked to a smaller id
    data = [(3, a), (3, a), (4, a + " more"), (None, b), (None, b + " more"), (None, b), (2, c), (8, c + " more"), (8, d), (None, c), (9, e), (9, ""), (9, ""), (None, None)]
    df = plain.frame(spark, data)
    out = jaccard.keep_one(df)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and [t for i, t in got if i is None and t in (b, b + " more")] in ([b], [b + " more"])
    assert sorted((x for x in got if x[0] is not None or x[1] is None), key=repr) == sorted([(3, a), (2, c), (8, d), (9, e), (9, ""), (9, ""), (None, None)], key=repr) and len(got) == 8


def test_components_of_a_chain(spark):
    from ledgerlake.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = dict(map(tuple, jaccard.components(links, Scratch(spark, "t")).select("id", "component").collect()))
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}
    assert list(itertools.islice(jaccard.bands(90)[0], 3)) == [1, 2, 3]
