"""Sharding, the pipeline, and that the rest works without this subpackage."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import compaction, jaccard, linededup, packing, quality, queries, substring
from ledgerlake.sources.manifest import Conflict

from . import plain
from .test_rows import counts, line_dedup


def test_merges_are_by_size_and_stop_at_the_target():
    tiers = compaction.Tiers(target_bytes=1000, fanout=3, smallest=10)
    r = random.Random(1)
    sizes, rewritten, arrived = [], 0, 0
    for _ in range(300):
        sizes += [r.randint(1, 30) for _ in range(r.choice([1, 1, 1, 20]))]
        arrived = arrived + sum(sizes[-1:])
        groups = compaction.due_merges(sizes, tiers)
        flat = [i for g in groups for i in g]
        assert len(flat) == len(set(flat)) and all(len(g) >= 3 and all(tiers.tier(sizes[i]) >= 0 for i in g) for g in groups)
        new = [sum(sizes[i] for i in g) for g in groups]
        rewritten += sum(new)
        sizes = [s for i, s in enumerate(sizes) if i not in set(flat)] + new
        assert all(n < tiers.target_bytes * 3 for n in new)
    assert len([s for s in sizes if tiers.tier(s) >= 0]) <= 2 * 6 and rewritten <= 6 * sum(sizes)
    # through several tiers at once: 27 shards of one size are one merge
    assert compaction.due_merges([10] * 27, tiers) == [list(range(27))] and compaction.due_merges([10] * 2, tiers) == []
    assert compaction.due_merges([900, 1, 900, 1, 1], tiers) == [[1, 3, 4]]


def test_store_keeps_every_row_at_every_version(spark, tmp_path):
    data = plain.rows(4, 40)
    df = plain.frame(spark, data).withColumn("_arrival", F.col("doc_id") * 2).withColumn("row", F.lit("x"))
    store = compaction.ShardStore(spark, str(tmp_path / "s"), compaction.Tiers(target_bytes=1 << 20, fanout=2, smallest=1 << 10, keep_versions=9))
    want = lambda rows: sorted((tuple(x) for x in rows.collect()), key=repr)
    seen = df.limit(0)
    for k in range(5):
        part = df.where(f"coalesce(doc_id, 0) % 5 = {k}")
        seen = seen.union(part)
        v = store.append(part, F.col("doc_id") % 2 if k == 3 else None)
        assert store.read(v).columns == df.columns and want(store.read(v)) == want(seen)
    before = store.read(v)
    after = store.compact()
    assert after > v and len(store.shards()) < 6
    for rows in (store.read(), before, store.read(v), store.read_placed().drop("shard")):
        assert want(rows) == want(df)
    per_shard = {r["shard"]: r["count"] for r in store.read_placed().groupBy("shard").count().collect()}
    assert per_shard == {i: s["rows"] for i, s in enumerate(store.shards())}
    assert store.append(df.limit(0)) == after  # an empty arrival publishes nothing
    store.manifests.publish(after + 1, {"shards": []})
    with pytest.raises(Conflict):
        store.manifests.publish(after + 1, {"shards": []})


def test_empty_store_and_schemas(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    v = store.append(empty)
    assert store.compact() == v and store.read().collect() == [] and store.read_placed().columns == ["doc_id", "text", "shard"] and store.read_placed().collect() == []
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 5)], "doc_id long, text string, extra int"))
    assert sorted(map(tuple, store.read().collect()), key=repr) == [(1, "a", None), (2, "b", 5)]
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    folder = tmp_path / "in"
    for name, shape in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),):
        spark.createDataFrame([], shape).write.parquet(str(folder / f"{name}.parquet"))
    assert queries.op7_tiered_shards(spark, str(folder)).collect() == []


@pytest.mark.parametrize("keep", [1, 2, 9])
def test_writers_that_race_lose_nothing(spark, tmp_path, keep):
    frame = lambda a: spark.range(a, a + 10).withColumn("text", F.lit("x"))
    tiers = compaction.Tiers(fanout=2, keep_versions=keep, grace_seconds=0)
    store, other = (compaction.ShardStore(spark, str(tmp_path / "s"), tiers) for _ in range(2))
    store.append(frame(0))
    store.append(frame(10))
    reader, rewrite = store.read(), store._rewrite
    started = {}

    def interleaved(files, folder, schema):
        if not started:
            started["version"] = other.append(frame(20))
        return rewrite(files, folder, schema)

    store._rewrite = interleaved
    version = store.merge()
    assert version > started["version"] and sorted(r.id for r in store.read().collect()) == list(range(30))
    if keep > 2:
        assert reader.count() == 20  # a reader that planned before still ends
    # another merge of the same shards is given up, and its files go
    started.clear()
    shards = len(store.shards())
    late = {}

    def overtaken(files, folder, schema):
        if not late:
            late["version"] = other.merge()
        return rewrite(files, folder, schema)

    store._rewrite = overtaken
    assert shards == 2 and store.merge() is None
    assert sorted(r.id for r in store.read().collect()) == list(range(30)) and len(store.shards()) == 1
    named = {compaction._folder(f) for v in store.manifests.versions() for s in store.shards(v) for f in s["files"]}
    assert {p.rsplit("/", 1)[1] for p, _ in store.manifests.folders(f"{store.root}/data")} == named
    assert len(store.manifests.versions()) == min(keep, late["version"])
    (tmp_path / "s" / "data" / "left").mkdir()
    assert store.sweep(0) == 1 and store.read().count() == 30


def test_large_shards_of_small_files_are_gathered(spark, tmp_path):
    r = random.Random(5)
    data = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))) for i in range(1200)]
    tiers = compaction.Tiers(target_bytes=60_000, fanout=4, smallest=1000)
    store = compaction.ShardStore(spark, str(tmp_path / "s"), tiers)
    store.append(spark.createDataFrame(data[:600], "doc_id long, text string").repartition(40))
    assert tiers.tier(store.shards()[0]["bytes"]) == -1  # too large for the tiers
    store.append(spark.createDataFrame(data[600:], "doc_id long, text string").repartition(2))
    large = store.shards()[1]["files"]
    version = store.compact()
    for s in store.shards():
        assert len([n for n in s["sizes"] if 2 * n < tiers.target_bytes]) <= 1 and len(s["files"]) <= 5 and s["rows"] == 600
    assert sorted(map(tuple, store.read(version).collect())) == data
    # files that are large enough stay where they are
    assert compaction.small_files({"sizes": [90_000, 100, 200]}, tiers) == [1, 2] and store.shards()[1]["files"] == large


def test_arrivals_are_brought_together_and_follow_the_input(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(0, 4000, 1, 8), F.pmod("id", F.lit(5)).cast("int"))
    assert [len(s["files"]) for s in store.shards()] == [1] * 5 and store.read().count() == 4000
    assert queries.arrivals(500 << 20) == queries.ARRIVALS and queries.arrivals(30 << 30) == 960


def test_shard_query_returns_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    import hashlib

    want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    rows = queries.op7_tiered_shards(spark, sf).collect()
    assert sorted((r.doc_id, r.text_sha256) for r in rows) == want
    arrival = {r.doc_id: r.a for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(queries.ARRIVALS)).alias("a")).collect()}
    assert all(r.arrival == arrival[r.doc_id] for r in rows)
    # one version for the append and one for the merges; an arrival is never torn, and 16 small ones are one shard
    assert {r.version for r in rows} == {2} and {r.shard for r in rows} == {0} and len({r.arrival for r in rows}) == queries.ARRIVALS


def test_pipeline_matches_plain_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(400)}" for _ in range(90)) for _ in range(12)]
    texts = [*base, base[0], base[1] + " more", "\n".join(f"line {i} of a b c" for i in range(30)), "x\n" + "\n".join(f"line {i} of a b c" for i in range(30)), "intro words here " + base[2], None, "", "short"]
    texts += [" ".join(f"q{r.randrange(300)}" for _ in range(70)) for _ in range(10)]
    data = list(enumerate(texts))
    folder = tmp_path / "in"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    names = docs.columns
    now = data
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(folder)).collect(), docs.schema)
        assert docs.columns == names
        if name == "quality_rules":  # no label certifies a cutoff here
            now = [(i, t) for i, t in now if (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
        elif name == "line_dedup":
            now = [(i, t) for i, _, gone, t in line_dedup(now) if not gone or t.strip()]
        elif name == "jaccard_join":
            now = [(i, t) for (i, t) in now if {d: c for d, _, c in plain.classes(now, 80, 5)}[i] == i]
        else:
            told = {i: (n, gone, h) for i, n, gone, h in plain.substring(now)}
            got = {x.doc_id: x.text for x in docs.collect()}
            assert sorted(got) == sorted(i for i, (n, gone, _) in told.items() if not gone or gone < n)
            import hashlib

            assert all(hashlib.sha256(b" ".join(plain.words(t))).hexdigest() == told[i][2] for i, t in got.items())
            now = list(got.items())
        assert sorted((x.doc_id, x.text) for x in docs.collect()) == sorted(now)
    rows = corpus_pipeline.run(spark, str(folder)).collect()
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for x in rows:
        lengths[x.doc_id] = lengths.get(x.doc_id, 0) + x.length
    assert lengths == {i: len(ref.encode(t, add_special_tokens=False).ids) + 1 for i, t in now}
    assert all(m for m in (jaccard, linededup, packing, quality, substring))


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(80))
    same = text()
    data = [(None, same), (None, same), (3, same), (None, text()), (4, text() + " " + " ".join(f"日本{i}" for i in range(70))), (5, None), (5, ""), (6, "x " * 5000)]
    inner = ["lang", "key", "row", "id", "d1", "_stratum", "n_lines", "spans", "carried", "_d1", "_gone", "a.b", "label"]
    shape = ["doc_id", "text", *inner]
    rows = spark.createDataFrame([(i, t, *(f"{c}{k % 2}" for c in inner)) for k, (i, t) in enumerate(data)], shape)
    empty = spark.createDataFrame([], rows.schema)
    for name, docs in (("odd", rows), ("empty", empty)):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        now = spark.read.parquet(str(folder / "documents.parquet"))
        schema = now.schema
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(folder))
            assert out.columns == shape
            now = spark.createDataFrame(out.collect(), schema)
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        if name == "empty":
            assert now.collect() == [] and packed == []
        else:
            left = [(x.doc_id, x.text) for x in now.collect()]
            assert sorted(left, key=repr) == sorted([(3, same), data[3], data[4]], key=repr) and sum(x.length for x in packed) > 160
            assert all(tuple(x)[2:] in {tuple(y)[2:] for y in rows.collect()} for x in now.collect())


def test_pipeline_writes_token_ids(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    data = [(1, "some words\nof a text"), (2, "longer " * 3000), (3, ""), (4, None)]
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for x in sorted(corpus_pipeline.best_fit_packing(spark, plain.frame(spark, data), "").collect(), key=lambda x: (x.doc_id, x.piece)):
        assert len(x.ids) == x.length
        ids[x.doc_id] = ids.get(x.doc_id, []) + x.ids
    assert ids == {i: [*ref.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in data}


def test_the_rest_imports_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/ledgerlake", tmp_path / "ledgerlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
