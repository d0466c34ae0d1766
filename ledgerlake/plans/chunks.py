"""Registered queries over chunks: codecs, checkpoints, audits of structures, paging. Each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs as C, scalar as S
from ..operators import audit, catalog, ranks, sets
from ..sources import fixtures as X
from ..streaming import pages
from .registry import ENT, KV, LOG, NODES, edges, entries, kv_hex, nodes, query


def le(x: str, width: int) -> str:
    """SQL for the hex of a little-endian integer."""
    return "(" + " || ".join(f"substr(printf('%016X', {x}), {15 - 2 * i}, 2)" for i in range(width)) + ")"


# --- codecs: what is encoded, in hex, and what decoding gives back


@query(
    "S16_frame_codec",
    f"SELECT c_custkey AS x, '4C4C4331' || {le('c_custkey % 6', 1)} || '00' || {le('c_custkey * 1000003', 8)} || {le('strlen(c_name)', 2)} || hex(c_name) AS head, "
    "4056 AS bytes, c_custkey % 6 AS kind, c_custkey * 1000003 AS seq, c_name AS payload, c_custkey % 5 > 0 AS readable FROM customer",
)
def _(spark, sf):
    """Every fifth frame has a reserved flag set and must not be read."""
    name, key = F.col("c_name").cast("binary"), F.col("c_custkey")
    made = X.table(spark, sf, "customer").select(key.alias("x"), name.alias("name"), C.encode_frame(key % 6, key * 1000003, name).alias("frame"))
    forged = F.when(F.col("x") % 5 == 0, F.unhex(F.overlay(F.hex("frame"), F.lit("01"), F.lit(11)))).otherwise(F.col("frame"))
    told, back = C.decode_frame(forged), C.decode_frame(F.col("frame"))
    head = F.hex("frame").substr(F.lit(1), 2 * (C.HEADER + F.octet_length("name")))
    return made.select("x", head.alias("head"), F.octet_length("frame").alias("bytes"), back["kind"].alias("kind"), back["seq"].alias("seq"), back["payload"].cast("string").alias("payload"), told.isNotNull().alias("readable"))


_LEAF = f"string_agg('0800' || printf('%016X', log_id) || '08000000' || {le('batch_id', 8)}, '' ORDER BY log_id)"


@query("S18_leaf_codec", f"WITH {ENT} SELECT namespace, leaf, sha256(unhex('00' || {le('namespace', 1)} || {le('count(*)', 2)} || {_LEAF})) AS h, count(*) AS n, min(log_id) AS first_id, max(batch_id) AS last_batch FROM idx GROUP BY namespace, leaf")
def _(spark, sf):
    entry = F.struct(S.big_endian(F.col("log_id")).alias("key"), S.little_endian(F.col("batch_id")).alias("value"))
    made = entries(spark, sf).groupBy("namespace", "leaf").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    coded = made.select("namespace", "leaf", C.encode_leaf(F.col("namespace"), F.col("e")).alias("b"))
    told = coded.select("*", C.decode_leaf(F.col("b")).alias("d"))
    last = F.element_at("d.items", -1)["value"]
    back = S.from_big_endian(F.unhex(F.concat(*(F.substring(F.hex(last), 15 - 2 * i, 2) for i in range(8)))))
    return told.select(F.col("d.namespace").cast("int").alias("namespace"), "leaf", F.sha2("b", 256).alias("h"), F.size("d.items").cast("long").alias("n"), S.from_big_endian(F.element_at("d.items", 1)["key"]).alias("first_id"), back.alias("last_batch"))


_CHILD = f"string_agg('0800' || printf('%016X', first_key) || {le('slot', 8)} || upper(sha256(CAST(first_key AS VARCHAR))), '' ORDER BY first_key)"


@query("S18_internal_codec", f"WITH {NODES} SELECT namespace, sha256(unhex('01' || {le('namespace', 1)} || {le('count(*)', 2)} || {_CHILD})) AS h, count(*) AS n, max(slot) AS last_slot FROM nodes GROUP BY namespace")
def _(spark, sf):
    child = F.struct(S.big_endian(F.col("first_key")).alias("first_key"), F.col("slot"), F.unhex(F.sha2(F.col("first_key").cast("string"), 256)).alias("hash"))
    made = nodes(entries(spark, sf)).groupBy("namespace").agg(F.array_sort(F.collect_list(child)).alias("c"))
    told = made.select(C.encode_internal(F.col("namespace"), F.col("c")).alias("b")).select("b", C.decode_internal(F.col("b")).alias("d"))
    return told.select(F.col("d.namespace").alias("namespace"), F.sha2("b", 256).alias("h"), F.size("d.items").cast("long").alias("n"), F.element_at("d.items", -1)["slot"].alias("last_slot"))


@query(
    "S19_commit_codec",
    f"WITH {NODES}, roots AS (SELECT namespace, max(slot) AS slot, sha256(CAST(max(first_key) AS VARCHAR)) AS h FROM nodes GROUP BY namespace), "
    f"c AS (SELECT {le('count(*)', 2)} || string_agg({le('namespace', 1)} || '01' || {le('slot', 8)} || upper(h), '' ORDER BY namespace) || upper(sha256(unhex(string_agg(h, '' ORDER BY namespace)))) AS b FROM roots) "
    "SELECT namespace, 1 AS kind, slot, h, (SELECT b FROM c) AS b FROM roots",
)
def _(spark, sf):
    roots = nodes(entries(spark, sf)).groupBy("namespace").agg(F.max("slot").alias("slot"), F.unhex(F.sha2(F.max("first_key").cast("string"), 256)).alias("hash"))
    one = F.struct(F.col("namespace").cast("long").alias("namespace"), F.lit(1).cast("long").alias("kind"), "slot", "hash")
    commit = roots.agg(F.array_sort(F.collect_list(one)).alias("r")).select(C.encode_commit(F.col("r")).alias("b"))
    told = commit.select("b", F.explode(C.decode_commit(F.col("b"))["roots"]).alias("r"))
    return told.select(F.col("r.namespace").alias("namespace"), F.col("r.kind").alias("kind"), F.col("r.slot").alias("slot"), F.lower(F.hex("r.hash")).alias("h"), F.hex("b").alias("b"))


@query("I2_commit_hash", "SELECT o_orderkey AS x FROM orders WHERE o_orderkey % 6 = 1")
def _(spark, sf):
    """Commits whose stored hash isn't that of their roots: every sixth is forged."""
    key = F.col("o_orderkey")
    root = F.struct(F.lit(3).cast("long").alias("namespace"), F.lit(1).cast("long").alias("kind"), key.cast("long").alias("slot"), F.unhex(F.sha2(key.cast("string"), 256)).alias("hash"))
    other = lambda b: F.translate(F.substring(b, -4, 4), "0123456789ABCDEF", "FEDCBA9876543210")
    stored = C.let(F.hex(C.encode_commit(F.array(root))), lambda b: F.when(key % 6 == 1, F.overlay(b, other(b), F.length(b) - 3)).otherwise(b))
    return X.table(spark, sf, "orders").where(C.decode_commit(F.unhex(stored)).isNull() & (key > 0)).select(key.alias("x"))


# --- checkpoints: 501 slots a chunk


_SLOTS = "s AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS rk FROM (SELECT DISTINCT o_custkey AS slot FROM orders))"


def _chain(spark, sf):
    """Chunks of a checkpoint over the customers with orders: chunk, encoded bytes."""
    owned = X.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("slot"), F.lit(0).alias("one")).distinct()
    ranked = ranks.global_rank(owned, "one", "slot").withColumn("chunk", F.floor(F.col("rk") / S.CHECKPOINT_ENTRIES))
    slices = ranked.groupBy("chunk").agg(F.array_sort(F.collect_list("slot")).alias("owned"))
    none = F.expr("cast(array() as array<bigint>)")
    return slices.select("chunk", C.encode_checkpoint(F.lit(9), F.lit(10_000_000), F.col("chunk") + 1, F.col("owned"), none).alias("b"))


@query("S11_checkpoint_write", f"WITH {_SLOTS} SELECT rk // 501 AS chunk, sha256(unhex({le('9', 8)} || {le('10000000', 8)} || {le('rk // 501 + 1', 8)} || {le('count(*)', 4)} || '00000000' || string_agg({le('slot', 8)}, '' ORDER BY slot))) AS h, 32 + 8 * count(*) AS bytes FROM s GROUP BY rk // 501")
def _(spark, sf):
    return _chain(spark, sf).select("chunk", F.sha2("b", 256).alias("h"), F.octet_length("b").cast("long").alias("bytes"))


@query("S11_checkpoint_read", f"WITH {_SLOTS} SELECT slot, rk // 501 AS chunk FROM s")
def _(spark, sf):
    return _chain(spark, sf).select("chunk", F.explode(C.decode_checkpoint(F.col("b"))["owned"]).alias("slot"))


@query("S9_fast_open", "SELECT o_orderkey AS slot FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey % 2 = 0")
def _(spark, sf):
    """Slots below the high-water mark are looked at only where the checkpoint names them, those above it all; the owner's open."""
    chunks = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_custkey").alias("seal"))
    high = 3000
    named = chunks.where((F.col("slot") < high) & (F.col("slot") % 4 == 1) & (F.col("seal") % 2 == 0)).select("slot")
    return audit.fast_open(chunks, named, high).where((F.col("slot") % 4 == 1) & (F.col("seal") % 2 == 0)).select("slot")


@query("S13_read_slot", "SELECT o_orderkey AS slot, o_orderpriority AS payload FROM orders WHERE o_orderkey = 35")
def _(spark, sf):
    return X.table(spark, sf, "orders").where("o_orderkey = 35").select(F.col("o_orderkey").alias("slot"), F.col("o_orderpriority").alias("payload"))


@query("S15_garbage", "SELECT 1000 + i AS slot, 4056 AS bytes FROM range(700) t(i)")
def _(spark, sf):
    """Chunks of random bytes that nobody can open, from a slot on."""
    return sets.garbage(spark, 1000, 700).select("slot", F.octet_length("payload").alias("bytes"))


# --- keys


@query("S20_space_keys", "SELECT c_custkey AS x, sha256(c_name) AS container_id, sha256(c_mktsegment) AS aead_root FROM customer")
def _(spark, sf):
    raw = F.unhex(F.concat(F.sha2(F.col("c_name").cast("binary"), 256), F.sha2(F.col("c_mktsegment").cast("binary"), 256)))
    told = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("x"), C.split_space_keys(raw).alias("k"))
    return told.select("x", F.lower(F.hex("k.container_id")).alias("container_id"), F.lower(F.hex("k.aead_root")).alias("aead_root"))


@query("S21_key_list", f"WITH {KV}, f AS (SELECT {le('count(*)', 4)} || string_agg({le('strlen(key)', 4)} || hex(key), '' ORDER BY key) AS b FROM kv WHERE namespace = 1) SELECT hex(key) AS key, b FROM kv, f WHERE namespace = 1")
def _(spark, sf):
    framed = X.kv_state(spark, sf).where("namespace = 1").agg(C.frame_keys(F.array_sort(F.collect_list("key"))).alias("b"))
    return framed.select(F.explode(C.unframe_keys(F.col("b"))).alias("key"), F.hex("b").alias("b")).select(F.hex("key").alias("key"), "b")


@query("F24_presets", "SELECT o_orderkey AS x, CASE o_orderkey % 5 WHEN 0 THEN 8192 WHEN 1 THEN 16384 WHEN 2 THEN 65536 WHEN 3 THEN 262144 END AS m_cost_kib FROM orders")
def _(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("min", "light", "default", "heavy", "huge"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), S.preset_memory(name).alias("m_cost_kib"))


@query("S5_header", "SELECT r_regionkey AS x, 8192 * (r_regionkey + 1) AS m_cost_kib, r_regionkey + 1 AS t_cost, 1 AS p_cost, 3 AS version, CASE r_regionkey WHEN 1 THEN 64 WHEN 2 THEN 256 WHEN 3 THEN 4096 ELSE 0 END AS bucket, CASE WHEN r_regionkey = 0 THEN 'floor' END AS fault FROM region")
def _(spark, sf):
    """Headers of 16 bytes, read without a password."""
    key = F.col("r_regionkey")
    raw = S.encode_params(8192 * (key + 1), key + 1, F.lit(1), S.with_padding_index(F.lit(3), key))
    told = X.table(spark, sf, "region").select(key.alias("x"), S.decode_params(raw).alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    bucket = S.bucket_of_index(S.padding_index(word(3)).cast("int"))
    return told.select("x", word(0).alias("m_cost_kib"), word(1).alias("t_cost"), word(2).alias("p_cost"), S.format_version(word(3)).alias("version"), bucket.alias("bucket"), S.params_fault(word(0), word(1), word(2), word(3)).alias("fault"))


# --- audits


_FORGED = f"{NODES}, filed AS (SELECT *, CASE WHEN leaf % 6 = 4 THEN 9 ELSE namespace END AS told FROM nodes)"


@query("I4_namespace", f"WITH {_FORGED} SELECT slot FROM filed WHERE told <> namespace")
def _(spark, sf):
    """Nodes that say another namespace than their root's: every sixth."""
    nd = nodes(entries(spark, sf))
    told = nd.withColumn("told", F.when(F.col("leaf") % 6 == 4, 9).otherwise(F.col("namespace")))
    return audit.other_namespace(told, "told", "namespace").select("slot")


@query(
    "M15_subtree_audit",
    f"WITH {_FORGED} SELECT 'namespace' AS fault, slot FROM filed WHERE told <> namespace AND namespace = 3 "
    "UNION ALL SELECT 'hash', slot FROM filed WHERE namespace = 3 AND leaf % 5 = 3 UNION ALL SELECT 'seen twice', slot FROM filed WHERE namespace = 3 AND leaf % 7 = 2",
)
def _(spark, sf):
    """All faults below one root, by kind."""
    nd = nodes(entries(spark, sf)).where("namespace = 3").withColumn("payload_hash", F.sha2(F.col("first_key").cast("string"), 256))
    nd = nd.withColumn("told", F.when(F.col("leaf") % 6 == 4, 9).otherwise(F.col("namespace")))
    forged = nd.select(F.col("slot").alias("child_slot"), F.when(F.col("leaf") % 5 == 3, "forged").otherwise(F.col("payload_hash")).alias("child_hash"))
    e = edges(nd).join(forged, "child_slot")
    return audit.subtree(nd, e, e.where("ord % 7 = 2"))


@query("M13_traversal_guard", "SELECT * FROM (VALUES ('budget', CAST(NULL AS BIGINT)), ('depth', CAST(40 AS BIGINT))) t(fault, slot)")
def _(spark, sf):
    """A chain of 40 nodes where 12 levels are allowed, in a container of 30 chunks."""
    chain = spark.range(1, 40).select(F.col("id").alias("parent_slot"), (F.col("id") + 1).alias("child_slot"))
    return audit.traversal_faults(spark.createDataFrame([(1,)], "slot long"), chain, max_depth=39, budget=30).select("fault", "slot")


@query("M4_stats_info", f"WITH {KV}, {LOG}, c AS (SELECT namespace FROM kv UNION ALL SELECT namespace FROM log) SELECT count(DISTINCT namespace) AS namespaces, count(*) AS entries, 4 * count(DISTINCT namespace) AS total, 0.25 AS utilization, CAST(NULL AS VARCHAR) AS hardening_error FROM c")
def _(spark, sf):
    found = catalog.namespaces(X.kv_state(spark, sf), X.log_state(spark, sf))
    one = found.agg(F.count("*").alias("namespaces"), F.sum("n").alias("entries"))
    total = 4 * F.col("namespaces")
    return one.select("namespaces", "entries", total.alias("total"), catalog.utilization(F.col("namespaces"), total).alias("utilization"), F.lit(None).cast("string").alias("hardening_error"))


# --- pages


@query("T2_reverse_pages", f"WITH {LOG} SELECT log_id, (row_number() OVER (ORDER BY log_id DESC) - 1) // 50 AS page FROM log WHERE namespace = 3 AND log_id < 2621440")
def _(spark, sf):
    return pages.page_table(X.log_state(spark, sf), 3, 50, before=2621440, backward=True)


@query("T4_repack_pages", f"WITH {KV} SELECT hex(key) AS key, (row_number() OVER (ORDER BY key) - 1) // 512 AS page FROM kv WHERE namespace = 2")
def _(spark, sf):
    """A namespace in the pages of 512 entries that a copy takes, a transaction each."""
    kv = X.kv_state(spark, sf).where("namespace = 2").select("namespace", "key", F.conv(F.substring(F.hex("key"), 21, 16), 16, 10).cast("decimal(20,0)").cast("long").alias("order"))
    return kv_hex(sets.numbered_pages(kv, "order", 512).select("key", "page"))


@query("T5_pointer_pages", f"WITH {ENT}, p AS (SELECT DISTINCT batch_id FROM idx WHERE namespace = 5) SELECT batch_id, (row_number() OVER (ORDER BY batch_id) - 1) // 512 AS page FROM p")
def _(spark, sf):
    pointers = entries(spark, sf).where("namespace = 5").select("namespace", "batch_id").distinct()
    return sets.numbered_pages(pointers, "batch_id", 512).select("batch_id", "page")
