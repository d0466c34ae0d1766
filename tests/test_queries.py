"""Every registered query against its SQL in DuckDB, and a few shapes of plans."""

import math

import duckdb
import pytest

from ledgerlake.operators import reads
from ledgerlake.plans import registry
from ledgerlake.sources import fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    res = duck.execute(registry.oracle_sql()[name])
    at = [d[0] for d in res.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(float(r[at.index(c)]) if type(r[at.index(c)]).__name__ == "Decimal" else r[at.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert [tuple(map(plain, g)) for g in got] == want


def test_pages_plan_as_top_k_with_pushed_filters(spark, sf, tmp_path):
    fixtures.messages(spark, sf).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = reads.log_before(log, 3, 5_000_000, 50)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "LessThan(log_id,5000000)" in plan


def test_batches_fit_and_keep_order(spark, sf):
    import zstandard

    from ledgerlake.functions import crypto

    log = fixtures.log_state(spark, sf).where("namespace = 3")
    payload = {r.log_id: bytes(r.payload) for r in log.collect()}
    batches = {}
    for r in registry.queries()["W11_batch_split"](spark, sf).collect():
        batches.setdefault(r.batch, []).append(r.log_id)
    assert sorted(i for ids in batches.values() for i in ids) == sorted(payload)
    size = lambda ids: len(zstandard.ZstdCompressor(level=3).compress(b"".join(i.to_bytes(8, "little") + len(payload[i]).to_bytes(4, "little") + payload[i] for i in ids)))
    ranked = {i: k for k, i in enumerate(sorted(payload))}
    for batch, ids in batches.items():
        ids.sort()
        assert len(ids) <= crypto.BATCH_RECORDS and size(ids) <= crypto.BATCH_BYTES
        assert [ranked[i] for i in ids] == list(range(ranked[ids[0]], ranked[ids[0]] + len(ids)))  # neighbours by id
    # a stretch is halved, so two neighbours that came from one half wouldn't have fitted together
    stretch = [i for i in sorted(payload)[: crypto.BATCH_RECORDS]]
    assert size(stretch) <= crypto.BATCH_BYTES or len([b for b in batches if b.startswith("0-")]) > 1


def test_codecs_refuse_what_breaks_a_rule(spark):
    from pyspark.sql import functions as F

    from ledgerlake.functions import codecs as C

    one = spark.createDataFrame([(b"a", b"1", b"b", b"")], "k binary, v binary, k2 binary, v2 binary")
    entry = lambda k, v: F.struct(F.col(k).alias("key"), F.col(v).alias("value"))
    told = one.select(
        C.decode_leaf(C.encode_leaf(F.lit(3), F.array(entry("k", "v"), entry("k2", "v2")))).alias("good"),
        C.decode_leaf(C.encode_leaf(F.lit(3), F.array(entry("k2", "v2"), entry("k", "v")))).alias("order"),
        C.decode_leaf(F.concat(C.encode_leaf(F.lit(3), F.array(entry("k", "v"))), F.lit(b"x"))).alias("longer"),
        C.decode_leaf(F.unhex(F.lit("0003FFFF"))).alias("count"),
        C.decode_internal(C.encode_leaf(F.lit(3), F.array(entry("k", "v")))).alias("kind"),
        C.decode_leaf(C.encode_leaf(F.lit(3), F.expr("cast(array() as array<struct<key:binary,value:binary>>)"))).alias("empty"),
        C.encode_frame(F.lit(1), F.lit(5), F.unhex(F.repeat(F.lit("00"), 4041))).alias("large"),
        C.decode_frame(F.lit(b"short")).alias("short"),
        C.decode_commit(F.lit(b"\xff\xff")).alias("commit"),
        C.decode_checkpoint(F.unhex(F.lit("00" * 24 + "FFFFFFFF" + "00000000"))).alias("checkpoint"),
        C.unframe_keys(F.unhex(F.lit("0200000001000000"))).alias("keys"),
        C.unframe_keys(C.frame_keys(F.array("k", "v2", "k2"))).alias("framed"),
        C.split_space_keys(F.lit(b"x" * 63)).alias("space"),
    ).first()
    assert [(bytes(e.key), bytes(e["value"])) for e in told.good["items"]] == [(b"a", b"1"), (b"b", b"")] and told.empty["items"] == [] and [bytes(k) for k in told.framed] == [b"a", b"", b"b"]
    assert all(told[c] is None for c in ("order", "longer", "count", "kind", "large", "short", "commit", "checkpoint", "keys", "space"))


def test_forged_commits_differ_and_are_made_once_a_row(spark, tmp_path):
    spark.createDataFrame([(2,), (7,), (836797,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))  # the hash of the last one's commit ends with 00FF
    found = registry.queries()["I2_commit_hash"](spark, str(tmp_path))
    assert sorted(r.x for r in found.collect()) == [7, 836797]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") < 10


def test_wide_inner_nodes_come_back_whole(spark):
    from pyspark.sql import functions as F

    from ledgerlake.functions import codecs as C, scalar as S

    child = lambda i: F.struct(S.big_endian(i).alias("first_key"), (i * 3).alias("slot"), F.unhex(F.sha2(i.cast("string"), 256)).alias("hash"))
    given = spark.range(1, 66_001).where(F.col("id").isin(1, 63, 64, 65, 129, 66_000)).select("id", F.transform(F.sequence(F.lit(1).cast("long"), "id"), child).alias("c"))
    node = given.select("*", C.encode_internal(F.lit(5), F.col("c")).alias("node")).localCheckpoint()
    back = node.select("id", F.octet_length("node"), C.decode_internal(F.col("node")).eqNullSafe(F.struct(F.lit(5).cast("long").alias("namespace"), F.col("c").alias("items"))))
    assert sorted(map(tuple, back.collect())) == [(n, 4 + 50 * n, True) for n in (1, 63, 64, 65, 129, 66_000)]
    broken = [F.expr("substring(node, 1, octet_length(node) - 1)"), F.expr("substring(node, 1, octet_length(node) - 50)"), F.concat("node", F.expr("substring(node, 5, 50)"))]
    told = node.where("id < 100").select(*(C.decode_internal(b) for b in broken))
    assert {tuple(r) for r in told.collect()} == {(None, None, None)}
    assert node.select(C.decode_internal(F.col("node")))._jdf.queryExecution().analyzed().toString().count("node#") < 5


def test_leaves_of_any_entries_come_back_whole(spark):
    from pyspark.sql import functions as F

    from ledgerlake.functions import codecs as C

    entry = lambda i: F.struct(F.lpad(i.cast("string"), 5, "0").cast("binary").alias("key"), F.repeat(F.lit("v"), (i % 300).cast("int")).cast("binary").alias("value"))
    given = spark.range(1, 1_001).where(F.col("id").isin(1, 64, 1_000)).select("id", F.transform(F.sequence(F.lit(1).cast("long"), "id"), entry).alias("e"))
    node = given.select("*", C.encode_leaf(F.lit(3), F.col("e")).alias("node")).localCheckpoint()
    back = node.select("id", C.decode_leaf(F.col("node")).eqNullSafe(F.struct(F.lit(3).cast("long").alias("namespace"), F.col("e").alias("items"))))
    assert sorted(map(tuple, back.collect())) == [(n, True) for n in (1, 64, 1_000)]
    assert node.select(C.decode_leaf(F.col("node")))._jdf.queryExecution().analyzed().toString().count("node#") < 5
    # a value said to have 2**32 - 1 bytes, one byte too few, a second entry that the count doesn't have
    broken = spark.createDataFrame([(bytearray.fromhex(h),) for h in ("0003010001006BFFFFFFFF", "0003010001006B0200000061", "0003010001006B000000000100790000000000")], "node binary")
    assert [r.d for r in broken.select(C.decode_leaf(F.col("node")).alias("d")).collect()] == [None] * 3
