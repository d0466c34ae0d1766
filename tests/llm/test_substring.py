import numpy as np
import pytest

from ledgerlake.llm import repeats, substring
from ledgerlake.llm.textvec import U, shingles

from . import plain


def told(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", [2, 7])
@pytest.mark.parametrize("window", [13, 4])
def test_matches_plain_version(spark, seed, window):
    data = plain.rows(seed)
    assert told(substring.remove_repeats(plain.frame(spark, data), window)) == plain.substring(data, window)


@pytest.mark.parametrize("window", [26, 50])
def test_levels_double_up_to_the_target(spark, window):
    r = np.random.default_rng(window)
    passage = [f"p{i}" for i in range(120)]
    word = lambda n: [f"w{x}" for x in r.integers(0, 10_000, n)]
    data = [(i, " ".join([*word(30), *passage[i : i + int(n)], *word(9)])) for i, n in enumerate(r.integers(5, 90, 25))]
    assert substring.levels(13) == [7, 13] and substring.levels(50) == [7, 13, 25, 50] and substring.levels(4) == [2, 4] and substring.levels(1) == [1]
    assert all(b <= 2 * a for w in range(2, 99) for a, b in zip(substring.levels(w), substring.levels(w)[1:]))
    for rows in (data, data[:1], [(i, " ".join(word(60))) for i in range(9)]):  # in the last two no candidate survives
        assert told(substring.remove_repeats(plain.frame(spark, rows), window)) == plain.substring(rows, window)


def test_other_columns_and_the_largest_id(spark):
    long = " ".join(f"v{i}" for i in range(40))
    inner = ["carried", "d1", "d2", "marks", "lowest", "starts", "copy", "key", "owner", "place", "id", "row", "spans", "n_removed", "a.b"]
    data = [((1 << 63) - 1, long), (3, "x " + long), (None, long + " y"), (7, "alone")]
    df = spark.createDataFrame([(i, t, *(f"{c}{k}" for c in inner)) for k, (i, t) in enumerate(data)], ["doc_id", "text", *inner])
    assert told(substring.remove_repeats(df)) == plain.substring(data)
    out = substring.dedup_documents(df)
    kept = {r[0]: r for r in out.collect()}
    assert out.columns == df.columns and set(kept) == {3, None, 7}
    assert kept[3] == df.where("doc_id = 3").first() and tuple(kept[None][2:]) == tuple(df.where("doc_id is null").first()[2:]) and kept[None].text.strip() == "y"
    assert substring.dedup_documents(df.limit(0)).collect() == []


def test_null_and_empty(spark):
    long = " ".join(f"v{i}" for i in range(40))
    data = [(None, long), (4, long + " tail"), (9, "head " + long), (None, "short"), (4, long)]
    assert told(substring.remove_repeats(plain.frame(spark, data))) == plain.substring(data)
    assert substring.remove_repeats(plain.frame(spark, data).limit(0)).collect() == []


def test_text_keeps_its_white_space(spark):
    a = " ".join(f"v{i}" for i in range(20))
    out = {r.doc_id: r for r in substring.remove_repeats(plain.frame(spark, [(1, a), (2, f"x\n\n{a}  y\tz")])).collect()}
    assert out[1].text == a and out[2].text == "x\n\ny\tz" and [tuple(s) for s in out[2].spans] == [(1, 20)]


def test_names_tell_windows_apart():
    h = np.random.default_rng(1).integers(0, 5, 400).astype(U)
    for length in (1, 2, 3, 7, 13):
        got, want = substring.names(h, length), [tuple(h[i : i + length]) for i in range(400 - length + 1)]
        assert len(got) == len(want)
        assert len({*zip(got.tolist(), want)}) == len({*got.tolist()}) == len({*want})


def test_repeated_with_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        r = np.random.default_rng(4)
        key, owner = r.integers(0, 60, 300), r.integers(0, 9, 300)
        key[:80], owner[80:120] = 7, 3
        place = np.arange(300)
        from pyspark.sql import functions as F

        def run(batches):
            for b in batches:
                i = b.column(0).to_numpy()
                yield repeats.marked(key[i].astype(U), owner[i], place[i])

        made = spark.range(0, 300, 1, 5).mapInArrow(run, repeats.SHAPE)
        rows = list(zip(key.tolist(), owner.tolist(), place.tolist()))
        for later in (False, True):
            got = sorted(tuple(x) for x in repeats.repeated(made, 3, later).select("key", "owner", "place").collect())
            low = {k: min(o for x, o, _ in rows if x == k) for k in {x[0] for x in rows}}
            high = {k: max(o for x, o, _ in rows if x == k) for k in {x[0] for x in rows}}
            assert got == sorted((k, o, p) for k, o, p in rows if (o > low[k] if later else high[k] > low[k]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_of_one_owner_are_told_apart_by_digest(spark):
    # more than 2**21 texts of one owner can't be made here: their digests fill all 64 bits, and come back whole
    digest = np.array([-(1 << 63), -1, 0, 1 << 40, (1 << 63) - 1], np.int64)
    n = len(digest)

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            yield repeats.marked((i // (n + 1)).astype(U), np.where(i % (n + 1), 9, 1), i, np.where(i % (n + 1), digest[i % (n + 1) - 1], 5))

    made = spark.range(0, 4 * (n + 1), 1, 3).mapInArrow(run, repeats.TEXT_SHAPE)
    for later in (False, True):
        got = sorted(tuple(x) for x in repeats.repeated(made, 3, later).select("key", "place", "text").collect())
        want = [(k, k * (n + 1) + j, int(digest[j - 1]) if j else 5) for k in range(4) for j in range(n + 1)]
        assert got == sorted(w for w in want if not later or w[1] % (n + 1))
    long = [" ".join(f"v{i}" for i in range(k, k + 30)) for k in range(40)]
    data = [*((None, t) for t in long), (4, long[3] + " tail"), (4, long[9]), (4, long[30] + " x")]
    assert told(substring.remove_repeats(plain.frame(spark, data))) == plain.substring(data)


def test_shingles_shorter_than_k():
    assert len(shingles(np.zeros(2, U), 3)) == 0
