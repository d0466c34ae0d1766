"""The registered queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..operators import audit, catalog, fold, maintain, ranks, reads, sets
from ..sources import fixtures as X
from ..streaming import pages

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The fixtures in SQL; keys and values as text, shown in hex.
KV = "kv AS (SELECT 1 AS namespace, r_name AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT 2, c_name, c_mktsegment FROM customer)"
LOG = "log AS (SELECT 3 AS namespace, conv_id * 65536 + turn AS log_id, text AS payload FROM conversations UNION ALL SELECT 5, epoch_us(ts) // 1000 * 1048576 + event_id, props FROM events)"
OPS = "ops AS (SELECT date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) + 2 AS seq, event_id AS op_ord, 6 AS namespace, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN event_type END AS value, event_type = 'error' AS is_delete FROM events)"
WIN = "win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY seq DESC, op_ord DESC) AS r FROM ops) WHERE r = 1)"
ENT = f"{LOG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY log_id) - 1 AS rk FROM log), idx AS (SELECT namespace, log_id, payload, rk, rk // 100 AS batch_id, rk // 64 AS leaf FROM ranked)"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def kv_hex(df: DataFrame) -> DataFrame:
    return df.select(*(F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))


CURSOR, PAGE = b"Customer#000000070", 25


# --- key/value and log reads


@query("K1_get", f"WITH {KV} SELECT hex(value) AS value FROM kv WHERE namespace = 2 AND key = 'Customer#000000070'")
def _(spark, sf):
    return kv_hex(reads.get(X.kv_state(spark, sf), 2, CURSOR))


@query("K2_list", f"WITH {KV} SELECT hex(key) AS key, hex(value) AS value FROM kv WHERE namespace = 2")
def _(spark, sf):
    return kv_hex(reads.list_all(X.kv_state(spark, sf), 2))


@query("K3_list_after", f"WITH {KV} SELECT hex(key) AS key, hex(value) AS value FROM kv WHERE namespace = 2 AND key > 'Customer#000000070' ORDER BY kv.key LIMIT 25")
def _(spark, sf):
    return kv_hex(reads.list_after(X.kv_state(spark, sf), 2, CURSOR, PAGE))


@query("K4_list_keys", f"WITH {KV} SELECT hex(key) AS key FROM kv WHERE namespace = 2")
def _(spark, sf):
    return kv_hex(reads.list_keys(X.kv_state(spark, sf), 2))


@query("K5_list_keys_after", f"WITH {KV} SELECT hex(key) AS key FROM kv WHERE namespace = 2 AND key > 'Customer#000000070' ORDER BY kv.key LIMIT 25")
def _(spark, sf):
    return kv_hex(reads.list_keys_after(X.kv_state(spark, sf), 2, CURSOR, PAGE))


@query("K6_count", f"WITH {KV} SELECT count(*) AS n FROM kv WHERE namespace = 2")
def _(spark, sf):
    return reads.count(X.kv_state(spark, sf), 2)


@query("K10_text_or_hex", f"WITH {KV} SELECT hex(key) AS key, value AS shown FROM kv")
def _(spark, sf):
    return X.kv_state(spark, sf).select(F.hex("key").alias("key"), S.text_or_hex(F.col("value")).alias("shown"))


@query("L1_read_log", f"WITH {LOG} SELECT hex(payload) AS payload FROM log WHERE namespace = 3 AND log_id = 65537")
def _(spark, sf):
    return kv_hex(reads.read_log(X.log_state(spark, sf), 3, 65537))


@query("L2_iter_log", f"WITH {LOG} SELECT log_id, hex(payload) AS payload FROM log WHERE namespace = 3")
def _(spark, sf):
    return kv_hex(reads.iter_log(X.log_state(spark, sf), 3))


@query("L3_log_after", f"WITH {LOG} SELECT log_id, hex(payload) AS payload FROM log WHERE namespace = 3 AND log_id > 655360 ORDER BY log_id LIMIT 50")
def _(spark, sf):
    return kv_hex(reads.log_after(X.log_state(spark, sf), 3, 655360, 50))


@query("L4_log_before", f"WITH {LOG} SELECT log_id, hex(payload) AS payload FROM log WHERE namespace = 3 ORDER BY log_id DESC LIMIT 50")
def _(spark, sf):
    return kv_hex(reads.log_before(X.log_state(spark, sf), 3, None, 50))


@query("L5_log_range", f"WITH {LOG} SELECT log_id, hex(payload) AS payload FROM log WHERE namespace = 3 AND log_id >= 327680 AND log_id < 1310720 ORDER BY log_id LIMIT 1000")
def _(spark, sf):
    return kv_hex(reads.log_range(X.log_state(spark, sf), 3, 327680, 1310720, 1000))


# --- the log's index and batches, as built from the state


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.global_rank(X.log_state(spark, sf), "namespace", "log_id").select("namespace", "log_id", "payload", "rk", F.floor(F.col("rk") / 100).alias("batch_id"), F.floor(F.col("rk") / 64).alias("leaf"))


def batches(ent: DataFrame) -> DataFrame:
    """Batches of 100 records: each is one row."""
    return ent.groupBy("namespace", "batch_id").agg(F.array_sort(F.collect_list(F.struct("log_id", "payload"))).alias("records"))


@query("L6_resolve", f"WITH {ENT} SELECT namespace, log_id, batch_id, hex(payload) AS payload FROM idx")
def _(spark, sf):
    ent = entries(spark, sf)
    return kv_hex(reads.resolve(ent.select("namespace", "log_id", "batch_id"), batches(ent)))


@query("L7_last_in_batch", f"WITH {ENT} SELECT namespace, batch_id, max(log_id) AS last_id, hex(arg_max(payload, log_id)) AS last_payload FROM idx GROUP BY ALL")
def _(spark, sf):
    last = F.element_at("records", -1)
    return batches(entries(spark, sf)).select("namespace", "batch_id", last["log_id"].alias("last_id"), F.hex(last["payload"]).alias("last_payload"))


@query("I7_batch_membership", f"WITH {ENT} SELECT namespace, log_id, batch_id FROM idx WHERE log_id % 97 = 0")
def _(spark, sf):
    """Every 97th record is missing from its batch: a forged structure."""
    ent = entries(spark, sf)
    return reads.unresolved(ent.select("namespace", "log_id", "batch_id"), batches(ent.where("log_id % 97 <> 0")))


@query("A11_batch_footprint", f"WITH {ENT} SELECT namespace, batch_id, CAST(sum(strlen(payload) + 32) AS BIGINT) AS footprint, count(*) AS records FROM idx GROUP BY ALL")
def _(spark, sf):
    return entries(spark, sf).groupBy("namespace", "batch_id").agg(F.sum(F.octet_length("payload") + 32).alias("footprint"), F.count("*").alias("records"))


# --- the journal


@query("W7_commit_fold", f"WITH {OPS}, {WIN} SELECT namespace, hex(key) AS key, hex(value) AS value, seq, op_ord FROM win WHERE NOT is_delete")
def _(spark, sf):
    return kv_hex(fold.fold(X.profile_ops(spark, sf)))


@query("W8_apply_ops", f"WITH {OPS}, base AS (SELECT namespace, key, value FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY seq DESC, op_ord DESC) AS r FROM ops WHERE seq <= 15) WHERE r = 1 AND NOT is_delete), {WIN} SELECT namespace, hex(key) AS key, hex(value) AS value FROM win WHERE NOT is_delete AND seq > 15 UNION ALL SELECT b.namespace, hex(b.key), hex(b.value) FROM base b JOIN win w USING (namespace, key) WHERE w.seq <= 15")
def _(spark, sf):
    ops = X.profile_ops(spark, sf)
    base = fold.fold(ops.where("seq <= 15")).select("namespace", "key", "value")
    return kv_hex(fold.apply(base, ops.where("seq > 15")))


@query("W5_tombstones", f"WITH {OPS}, {WIN} SELECT namespace, hex(key) AS key, seq, op_ord FROM win WHERE is_delete")
def _(spark, sf):
    return kv_hex(fold.winners(X.profile_ops(spark, sf)).where("is_delete").select("namespace", "key", "seq", "op_ord"))


@query("W10_carry_forward", f"WITH {KV}, old AS (SELECT namespace, count(*) AS n FROM kv GROUP BY ALL), fresh AS (SELECT 2 AS namespace, CAST(0 AS BIGINT) AS n) SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE namespace NOT IN (SELECT namespace FROM fresh)")
def _(spark, sf):
    old = X.kv_state(spark, sf).groupBy("namespace").agg(F.count("*").alias("n"))
    return fold.carry_forward(old, spark.createDataFrame([(2, 0)], "namespace smallint, n long"))


@query("W13_erase", f"WITH {KV} SELECT namespace, hex(key) AS key, hex(value) AS value FROM kv WHERE namespace <> 1")
def _(spark, sf):
    return kv_hex(fold.erase(X.kv_state(spark, sf), 1))


@query("W17_order_guard", f"WITH {OPS}, o AS (SELECT *, lag(key) OVER (PARTITION BY namespace ORDER BY op_ord) AS before FROM ops) SELECT namespace, hex(key) AS key, op_ord AS ord FROM o WHERE before >= key")
def _(spark, sf):
    return kv_hex(fold.out_of_order(X.profile_ops(spark, sf).select("namespace", "key", F.col("op_ord").alias("ord"))))


@query("W2_invalid_ops", f"WITH {OPS} SELECT hex(key) AS key, op_ord, CASE WHEN op_ord % 256 = 0 THEN 'namespace' WHEN strlen(key) > 2 THEN 'key' END AS reason FROM ops WHERE op_ord % 256 = 0 OR strlen(key) > 2")
def _(spark, sf):
    ops = X.profile_ops(spark, sf).withColumn("namespace", (F.col("op_ord") % 256).cast("smallint")).withColumn("key", F.when(F.octet_length("key") > 2, F.lit(b"").cast("binary")).otherwise(F.col("key")))
    shown = X.profile_ops(spark, sf).select("op_ord", F.hex("key").alias("key"))
    return fold.invalid(ops).select("op_ord", "reason").join(shown, "op_ord")


# --- catalog and versions


@query("M1_namespaces", f"WITH {KV}, {LOG} SELECT DISTINCT namespace FROM kv UNION SELECT DISTINCT namespace FROM log")
def _(spark, sf):
    return catalog.namespaces(X.kv_state(spark, sf), X.log_state(spark, sf)).select(F.col("namespace").cast("int").alias("namespace"))


@query("M2_namespaces_kind", f"WITH {KV}, {LOG} SELECT namespace, 'Kv' AS kind, count(*) AS n FROM kv GROUP BY ALL UNION ALL SELECT namespace, 'Log', count(*) FROM log GROUP BY ALL")
def _(spark, sf):
    return catalog.namespaces(X.kv_state(spark, sf), X.log_state(spark, sf)).withColumn("namespace", F.col("namespace").cast("int"))


@query("M3_stats", f"WITH {KV}, {LOG}, c AS (SELECT namespace, count(*) AS n FROM (SELECT namespace FROM kv UNION ALL SELECT namespace FROM log) GROUP BY ALL) SELECT count(*) AS namespaces, CAST(sum(n) AS BIGINT) AS entries, CAST(0.75 AS DOUBLE) AS utilization, string_agg(namespace || ':' || n, ',' ORDER BY namespace) AS counts FROM c")
def _(spark, sf):
    told = catalog.stats(catalog.namespaces(X.kv_state(spark, sf), X.log_state(spark, sf)), 3, 4)
    return told.select("namespaces", "entries", "utilization", F.array_join(F.transform("namespace_counts", lambda x: F.concat_ws(":", x.namespace, x["count"])), ",").alias("counts"))


@query("A1_count_by_namespace", f"WITH {LOG} SELECT namespace, count(*) AS n FROM log GROUP BY ALL")
def _(spark, sf):
    return X.log_state(spark, sf).groupBy(F.col("namespace").cast("int").alias("namespace")).agg(F.count("*").alias("n"))


@query("A2_total", f"WITH {KV}, {LOG} SELECT (SELECT count(*) FROM kv) + (SELECT count(*) FROM log) AS total")
def _(spark, sf):
    return catalog.namespaces(X.kv_state(spark, sf), X.log_state(spark, sf)).agg(F.sum("n").alias("total"))


@query("A3_utilization", "SELECT o_custkey AS space, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 0.0 ELSE count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P') END AS utilization FROM orders GROUP BY ALL")
def _(spark, sf):
    o = X.table(spark, sf, "orders")
    owned, total = F.count(F.when(F.col("o_orderstatus") == "F", 1)), F.count(F.when(F.col("o_orderstatus") != "P", 1))
    return o.groupBy(F.col("o_custkey").alias("space")).agg(owned.alias("a"), total.alias("b")).select("space", catalog.utilization(F.col("a"), F.col("b")).alias("utilization"))


@query("A12_secret_shape", f"WITH {OPS} SELECT namespace, count(*) AS items, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM ops GROUP BY ALL")
def _(spark, sf):
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return X.profile_ops(spark, sf).groupBy("namespace").agg(F.count("*").alias("items"), F.sum(size).alias("bytes"))


def superblocks(spark: SparkSession, sf: str) -> DataFrame:
    """Three replicas of each day's version; some can't be read."""
    seqs = X.profile_ops(spark, sf).select("seq").distinct()
    three = seqs.select("seq", F.explode(F.array(*map(F.lit, range(3)))).alias("replica"))
    return three.select("seq", "replica", (F.col("seq") * 3 + F.col("replica")).alias("slot"), (F.col("seq") % 10 != 1).alias("decodable"), F.when(F.col("seq") % 7 == 0, F.col("seq") - 1).otherwise(F.col("seq")).alias("root_seq"))


SB = f"{OPS}, seqs AS (SELECT DISTINCT seq FROM ops), sb AS (SELECT seq, replica, seq * 3 + replica AS slot, seq % 10 <> 1 AS decodable, CASE WHEN seq % 7 = 0 THEN seq - 1 ELSE seq END AS root_seq FROM seqs, (VALUES (0), (1), (2)) r(replica))"


@query("A5_max_version", f"WITH {SB} SELECT seq, slot, root_seq FROM sb WHERE decodable AND root_seq = seq ORDER BY seq DESC, slot DESC LIMIT 1")
def _(spark, sf):
    return catalog.newest(superblocks(spark, sf))


@query("A7_newer_unreadable", f"WITH {SB} SELECT max(seq) FILTER (decodable) AS chosen, CASE WHEN max(seq) FILTER (NOT decodable) > max(seq) FILTER (decodable) THEN max(seq) FILTER (NOT decodable) END AS newer_unreadable FROM sb")
def _(spark, sf):
    return catalog.newer_unreadable(superblocks(spark, sf))


@query("M5_commit_seq", f"WITH {OPS} SELECT max(seq) AS commit_seq FROM ops")
def _(spark, sf):
    return X.profile_ops(spark, sf).agg(F.max("seq").alias("commit_seq"))


@query("A6_history", f"WITH {OPS} SELECT string_agg(DISTINCT seq, ',' ORDER BY seq) AS history FROM ops")
def _(spark, sf):
    return catalog.history(X.profile_ops(spark, sf)).select(F.array_join("history", ",").alias("history"))


@query("P7_horizon", "SELECT o_orderkey AS seq FROM orders WHERE o_orderkey >= (SELECT max(o_orderkey) FROM orders) - 1024")
def _(spark, sf):
    return catalog.within_horizon(X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq")))


@query("F27_anchor_triage", "SELECT o_orderkey AS anchor, CASE WHEN 3000 < o_orderkey THEN 'rollback' WHEN o_orderkey % 5 = 0 THEN 'clean' WHEN 3000 - o_orderkey > 1024 THEN 'out_of_range' ELSE 'fork' END AS verdict FROM orders")
def _(spark, sf):
    history = F.sequence(F.lit(0).cast("long"), F.lit(3000).cast("long"), F.lit(5).cast("long"))
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("anchor"), catalog.triage(F.lit(3000), F.col("o_orderkey"), history).alias("verdict"))


# --- scalars


def _from_orders(name: str, spark_columns: Callable[[], list], sql_columns: str):
    @query(name, f"SELECT o_orderkey AS x, {sql_columns} FROM orders")
    def _(spark, sf):
        return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), *spark_columns())


_K = F.col
_from_orders("F1_be_key", lambda: [F.hex(S.big_endian(_K("o_orderkey"))).alias("be"), S.from_big_endian(S.big_endian(_K("o_orderkey"))).alias("back")], "lpad(to_hex(o_orderkey), 16, '0') AS be, o_orderkey AS back")
_from_orders("F2_le_pointer", lambda: [F.hex(S.little_endian(_K("o_orderkey"))).alias("le")], "(SELECT h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] FROM (SELECT lpad(to_hex(o_orderkey), 16, '0') AS h)) AS le")
_from_orders("F3_child_index", lambda: [S.child_index(_K("o_orderkey"), F.array(*map(F.lit, (100, 500, 1000, 20000)))).alias("child")], "CASE WHEN o_orderkey >= 20000 THEN 3 WHEN o_orderkey >= 1000 THEN 2 WHEN o_orderkey >= 500 THEN 1 ELSE 0 END AS child")
_from_orders("F6_entry_cost", lambda: [S.leaf_cost(_K("o_orderpriority"), _K("o_orderstatus")).alias("leaf"), S.child_cost(_K("o_orderpriority")).alias("child")], "CAST(6 + strlen(o_orderpriority) + strlen(o_orderstatus) AS INT) AS leaf, CAST(42 + strlen(o_orderpriority) AS INT) AS child")
_from_orders("F7_max_depth", lambda: [S.max_depth(_K("o_orderkey")).alias("depth")], "(SELECT count(*) FROM (VALUES (3), (8), (25), (90), (347), (1372), (5469), (21854), (87391), (349536), (1398113), (5592418)) t(n) WHERE n <= o_orderkey) AS depth")
_from_orders("F8_padding", lambda: [S.padding(F.lit("bucket"), F.lit(256), _K("o_orderkey"), F.lit(3)).alias("bucket"), S.padding(F.lit("bucket"), F.lit(0), _K("o_orderkey"), F.lit(3)).alias("zero"), S.padding(F.lit("ratio"), F.lit(150), F.lit(9), _K("o_orderkey")).alias("ratio")], "(o_orderkey + 255) // 256 * 256 - o_orderkey AS bucket, 0 AS zero, o_orderkey * 150 // 100 AS ratio")
_from_orders("F9_policy_index", lambda: [S.bucket_of_index((_K("o_orderkey") % 6).cast("int")).alias("chunks"), S.index_of_bucket((_K("o_orderkey") % 3 * 64).cast("int")).alias("idx")], "CASE o_orderkey % 6 WHEN 1 THEN 64 WHEN 2 THEN 256 WHEN 3 THEN 4096 ELSE 0 END AS chunks, CASE o_orderkey % 3 * 64 WHEN 0 THEN 0 WHEN 64 THEN 1 END AS idx")
_from_orders("F10_bitfields", lambda: [S.format_version(_K("o_orderkey") * 65537).alias("version"), S.padding_index(_K("o_orderkey") * 65537).alias("padding"), S.with_padding_index(_K("o_orderkey") * 65537, F.lit(2)).alias("changed")], "(o_orderkey * 65537) & 65535 AS version, ((o_orderkey * 65537) >> 16) & 255 AS padding, ((o_orderkey * 65537) & 65535) | 131072 AS changed")
_from_orders("F11_params", lambda: [S.params_fault(_K("o_orderkey") * 100, _K("o_orderkey") % 11, _K("o_orderkey") % 19, F.lit(3)).alias("fault")], "CASE WHEN o_orderkey % 11 < 2 OR o_orderkey * 100 < 8192 OR o_orderkey % 19 < 1 THEN 'floor' WHEN o_orderkey * 100 > 524288 OR o_orderkey % 11 > 8 OR o_orderkey % 19 > 16 THEN 'ceiling' END AS fault")
_from_orders("F12_params_bytes", lambda: [F.array_join(S.decode_params(S.encode_params(_K("o_orderkey"), F.lit(3), F.lit(4), F.lit(65539))), ",").alias("words"), F.octet_length(S.encode_params(_K("o_orderkey"), F.lit(3), F.lit(4), F.lit(65539))).alias("bytes")], "o_orderkey || ',3,4,65539' AS words, 16 AS bytes")
_from_orders("F13_reuse_floor", lambda: [S.reuse_floor(_K("o_orderkey")).alias("floor"), S.draws(_K("o_orderkey"), F.lit(700)).alias("draws")], "o_orderkey - o_orderkey // 2 AS floor, 2 * least(o_orderkey // 2, 700) AS draws")
_from_orders("F15_checkpoint_chunks", lambda: [S.checkpoint_chunks(_K("o_orderkey")).alias("chunks")], "greatest(CAST(ceil(o_orderkey / 501) AS BIGINT), 1) AS chunks")
_from_orders("F16_sha256", lambda: [F.sha2(_K("o_orderpriority").cast("binary"), 256).alias("h"), F.lower(F.hex(_K("o_orderstatus"))).alias("hex")], "sha256(o_orderpriority) AS h, lower(hex(o_orderstatus)) AS hex")
_from_orders("F23_names", lambda: [S.namespace_name(_K("o_orderkey") % 6).alias("name")], "CASE o_orderkey % 6 WHEN 1 THEN 'SETTINGS' WHEN 2 THEN 'CONTACTS' WHEN 3 THEN 'MESSAGE_LOG' WHEN 4 THEN 'MEDIA' ELSE '(custom)' END AS name")
_from_orders("F25_compact_trigger", lambda: [S.compact_due(_K("o_orderkey") % 10 / 10, _K("o_orderkey") * 10, _K("o_orderkey") % 30).alias("due"), S.overhead_band(_K("o_orderkey") % 101).alias("band")], "(o_orderkey % 10 / 10 < 0.5 AND o_orderkey * 10 > 1024) OR o_orderkey * 10 > 262144 OR o_orderkey % 30 > 14 AS due, CASE WHEN o_orderkey % 101 <= 30 THEN 'steady' WHEN o_orderkey % 101 <= 70 THEN 'vacuum' ELSE 'investigate' END AS band")
_from_orders("S12_checkpoint_due", lambda: [S.checkpoint_due(_K("o_orderkey"), F.when(_K("o_orderkey") % 3 > 0, _K("o_orderkey") - 2500), F.lit(100), _K("o_orderkey") % 300).alias("due")], "o_orderkey >= 4096 AND (o_orderkey % 3 = 0 OR 2500 > 2048 OR o_orderkey % 300 >= 256) AS due")
_from_orders("M33_outcomes", lambda: [S.settled(F.element_at(F.array(*map(F.lit, ("queued", "running", "never_started", "succeeded", "failed", "lost"))), (_K("o_orderkey") % 6 + 1).cast("int"))).alias("settled"), S.may_have_mutated(F.element_at(F.array(*map(F.lit, ("queued", "running", "never_started", "succeeded", "failed", "lost"))), (_K("o_orderkey") % 6 + 1).cast("int"))).alias("mutated")], "o_orderkey % 6 >= 2 AS settled, o_orderkey % 6 <> 2 AS mutated")


@query("F4_boundary_hash", "SELECT o_orderkey AS x, sha256(CAST('boundary:' || chr(1) || o_orderpriority AS VARCHAR))[1:16] AS h FROM orders")
def _(spark, sf):
    h = S.boundary_hash(F.lit(1), F.col("o_orderpriority").cast("binary"))
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), F.lower(F.lpad(F.conv(h.cast("string"), 10, 16), 16, "0")).alias("h"))


@query("F5_boundaries", "WITH k AS (SELECT o_orderkey, o_orderpriority || '-' || o_orderkey AS key FROM orders), h AS (SELECT o_orderkey, strlen(key) + 6 AS cost, CAST(CAST('0x' || sha256(encode('boundary:') || '\\x00'::BLOB || encode(key))[1:16] AS UBIGINT) AS HUGEINT) AS hash FROM k) SELECT o_orderkey AS x, hash * 2040 * 6 < CAST(cost AS HUGEINT) * 18446744073709551616 AS ends FROM h")
def _(spark, sf):
    key = F.concat_ws("-", "o_orderpriority", "o_orderkey").cast("binary")
    h = S.boundary_hash(F.lit(0), key)
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), S.is_boundary(h, S.leaf_cost(key, F.lit("").cast("binary")), F.lit(2000)).alias("ends"))


# --- structures over slots


def nodes(ent: DataFrame) -> DataFrame:
    """Leaves of 64 entries; slots are numbered by namespace and leaf."""
    return ent.groupBy("namespace", "leaf").agg(F.min("log_id").alias("first_key"), F.count("*").alias("n")).select((F.col("namespace") * 1000000 + F.col("leaf") + 1).cast("long").alias("slot"), "namespace", "leaf", "first_key", "n")


def edges(nd: DataFrame) -> DataFrame:
    return nd.select((F.col("namespace") * 1000000).cast("long").alias("parent_slot"), F.col("slot").alias("child_slot"), F.col("leaf").alias("ord"), "first_key")


NODES = f"{ENT}, nodes AS (SELECT namespace * 1000000 + leaf + 1 AS slot, namespace, leaf, min(log_id) AS first_key, count(*) AS n FROM idx GROUP BY namespace, leaf)"


@query("J3_orphan_index", f"WITH {NODES} SELECT slot FROM nodes WHERE namespace = 5")
def _(spark, sf):
    nd = nodes(entries(spark, sf))
    kept = audit.reachable(spark.createDataFrame([(3000000,)], "slot long"), edges(nd), 2)
    return audit.orphans(nd.select("slot"), kept)


@query("M12_reachable", f"WITH RECURSIVE {NODES}, e AS (SELECT namespace * 1000000 AS parent, slot AS child FROM nodes UNION ALL SELECT 1, 3000000 UNION ALL SELECT 1, 5000000), w AS (SELECT 1 AS slot, 0 AS depth UNION ALL SELECT e.child, depth + 1 FROM w JOIN e ON e.parent = w.slot) SELECT slot, min(depth) AS depth FROM w GROUP BY ALL")
def _(spark, sf):
    e = edges(nodes(entries(spark, sf))).select("parent_slot", "child_slot").union(spark.createDataFrame([(1, 3000000), (1, 5000000)], "parent_slot long, child_slot long"))
    return audit.reachable(spark.createDataFrame([(1,)], "slot long"), e, 4)


@query("J4_orphan_batches", f"WITH {ENT} SELECT DISTINCT namespace, batch_id FROM idx WHERE batch_id % 4 = 1")
def _(spark, sf):
    ent = entries(spark, sf)
    return maintain.unreferenced_batches(ent, ent.where("batch_id % 4 <> 1"))


@query("J5_retired_roots", "SELECT DISTINCT o_custkey AS root_slot FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def _(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("root_slot"), "o_orderkey")
    return maintain.retired_roots(o, o.where("o_orderkey % 2 = 0"))


@query("J7_key_range", f"WITH {NODES}, moved AS (SELECT namespace * 1000000 + CASE WHEN log_id % 211 = 0 THEN greatest(leaf - 1, 0) ELSE leaf END + 1 AS slot, log_id AS key FROM idx), r AS (SELECT *, lead(first_key) OVER (PARTITION BY namespace ORDER BY leaf) AS upper FROM nodes) SELECT m.slot, m.key FROM moved m JOIN r USING (slot) WHERE r.leaf > 0 AND m.key < r.first_key OR m.key >= r.upper")
def _(spark, sf):
    """Some entries are filed one leaf too low: a forged structure."""
    ent = entries(spark, sf)
    leaf = F.when(F.col("log_id") % 211 == 0, F.greatest(F.col("leaf") - 1, F.lit(0))).otherwise(F.col("leaf"))
    filed = ent.select((F.col("namespace") * 1000000 + leaf + 1).cast("long").alias("slot"), F.col("log_id").alias("key"))
    return audit.out_of_range(filed, edges(nodes(ent)))


@query("J8_anchor_known", f"WITH {OPS} SELECT o_orderkey AS seq FROM orders WHERE o_orderkey IN (SELECT seq FROM ops)")
def _(spark, sf):
    seqs = X.profile_ops(spark, sf).select("seq").distinct()
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq")).join(seqs, "seq", "left_semi")


@query("I3_hash_mismatch", f"WITH {NODES} SELECT namespace * 1000000 AS parent_slot, slot AS child_slot FROM nodes WHERE leaf % 5 = 3")
def _(spark, sf):
    nd = nodes(entries(spark, sf)).withColumn("payload_hash", F.sha2(F.col("first_key").cast("string"), 256))
    e = edges(nd).join(nd.select(F.col("slot").alias("child_slot"), F.when(F.col("leaf") % 5 == 3, "forged").otherwise(F.col("payload_hash")).alias("child_hash")), "child_slot")
    return audit.hash_mismatch(e, nd)


@query("I6_seen_twice", f"WITH {NODES} SELECT slot, CAST(2 AS BIGINT) AS n FROM nodes WHERE leaf % 7 = 2")
def _(spark, sf):
    e = edges(nodes(entries(spark, sf)))
    return audit.seen_twice(e.union(e.where("ord % 7 = 2")))


@query("A9_root_hash", f"WITH {NODES}, roots AS (SELECT namespace, sha256(CAST(max(first_key) AS VARCHAR)) AS h FROM nodes GROUP BY namespace) SELECT sha256(unhex(string_agg(h, '' ORDER BY namespace))) AS tx_root_hash FROM roots")
def _(spark, sf):
    roots = nodes(entries(spark, sf)).groupBy("namespace").agg(F.sha2(F.max("first_key").cast("string"), 256).alias("root_hash"))
    return audit.root_hash(roots)


@query("A10_integrity_report", f"WITH {NODES} SELECT (SELECT count(*) + 3 FROM nodes) AS chunks_verified, 2 AS max_depth, (SELECT count(*) FROM idx) AS entries, (SELECT count(DISTINCT namespace * 100000000 + batch_id) FROM idx) AS batches")
def _(spark, sf):
    ent = entries(spark, sf)
    all_nodes = nodes(ent).select("slot", F.lit(0).alias("level")).union(spark.createDataFrame([(3000000, 1), (5000000, 1)], "slot long, level int"))
    return audit.report(all_nodes, ent)


@query("M17_repack", f"WITH {KV}, s AS (SELECT *, 's' || (namespace % 3) AS space_id FROM kv) SELECT space_id, namespace, hex(key) AS key, hex(value) AS value FROM s WHERE space_id IN ('s1')")
def _(spark, sf):
    s = X.kv_state(spark, sf).withColumn("space_id", F.concat(F.lit("s"), F.col("namespace") % 3))
    return kv_hex(maintain.repack(s, ["s1"]))


@query("M19_rotation", f"WITH {KV}, s AS (SELECT *, 's' || (namespace % 3) AS space_id FROM kv) SELECT 'renewed' AS space_id, namespace, hex(key) AS key, hex(value) AS value FROM s WHERE space_id = 's2'")
def _(spark, sf):
    s = X.kv_state(spark, sf).withColumn("space_id", F.concat(F.lit("s"), F.col("namespace") % 3))
    return kv_hex(maintain.rotate(s, spark.createDataFrame([("s2", "renewed"), ("s9", "none")], "old_id string, new_id string")))


def _slots(spark, sf, table, column):
    return X.table(spark, sf, table).select(F.col(column).cast("long").alias("slot"))


@query("O5_union", "SELECT o_custkey AS slot FROM orders UNION SELECT l_partkey FROM lineitem")
def _(spark, sf):
    return sets.union(_slots(spark, sf, "orders", "o_custkey"), _slots(spark, sf, "lineitem", "l_partkey"))


@query("O6_difference", "SELECT o_orderkey AS slot FROM orders EXCEPT SELECT l_partkey FROM lineitem")
def _(spark, sf):
    return sets.difference(_slots(spark, sf, "orders", "o_orderkey"), _slots(spark, sf, "lineitem", "l_partkey"))


@query("O7_members", "SELECT c_custkey AS slot FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    return sets.members(_slots(spark, sf, "customer", "c_custkey"), _slots(spark, sf, "orders", "o_custkey"))


@query("O8_rank_select", "SELECT DISTINCT o_orderkey AS slot FROM orders ORDER BY 1 LIMIT 1 OFFSET 77")
def _(spark, sf):
    return sets.rank_select(_slots(spark, sf, "orders", "o_orderkey"), 77)


@query("O9_sample", "SELECT slot FROM (SELECT DISTINCT o_orderkey AS slot FROM orders) ORDER BY md5(slot || ':7'), slot LIMIT 100")
def _(spark, sf):
    return sets.sample(_slots(spark, sf, "orders", "o_orderkey"), 100, 7)


@query("O10_pool_below", "SELECT o_orderkey AS slot FROM orders WHERE o_orderkey < 5000 AND o_orderkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(spark, sf):
    return sets.below_and_unowned(_slots(spark, sf, "orders", "o_orderkey"), _slots(spark, sf, "lineitem", "l_partkey"), 5000)


@query("T1_pages", f"WITH {LOG} SELECT log_id, (row_number() OVER (ORDER BY log_id) - 1) // 50 AS page FROM log WHERE namespace = 5 AND log_id > 1000000")
def _(spark, sf):
    """The pages that a forward stream gives, as one table."""
    return pages.page_table(X.log_state(spark, sf), 5, 50, after=1000000)


@query("T3_range_pages", f"WITH {LOG} SELECT log_id, (row_number() OVER (ORDER BY log_id) - 1) // 20 AS page FROM log WHERE namespace = 3 AND log_id >= 65536 AND log_id < 2621440")
def _(spark, sf):
    """The pages that a range stream gives, as one table."""
    return pages.page_table(X.log_state(spark, sf), 3, 20, after=65535, before=2621440)


@query("S_media_chunks", "WITH d AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents), c AS (SELECT t, unnest(range(greatest(CAST(ceil(strlen(t) / 2048) AS BIGINT), 1))) AS i FROM d) SELECT count(*) AS chunks, CAST(sum(least(2048, strlen(t) - i * 2048)) AS BIGINT) AS bytes FROM c")
def _(spark, sf):
    return X.media(spark, sf).agg(F.count("*").alias("chunks"), F.sum(F.octet_length("value")).alias("bytes"))


@query("S6_trial_decrypt", f"WITH {KV} SELECT hex(key) AS key, hex(value) AS value FROM kv WHERE namespace = 2 AND substr(key, 18) IN ('0', '3', '6', '9')")
def _(spark, sf):
    """Sealed rows of two owners; one owner's key opens only its own."""
    from ..functions import crypto

    kv = X.kv_state(spark, sf).where("namespace = 2")
    mine = F.expr("substring(key, 18, 1)").cast("string").isin("0", "3", "6", "9")
    sealed = crypto.seal(kv, "value", F.when(mine, F.lit("owner-a")).otherwise(F.lit("owner-b")), F.hex("key"))
    return kv_hex(crypto.opened(sealed, "value", "owner-a", F.hex("key")).select("key", "value"))


@query("W11_batch_split")
def _(spark, sf):
    from ..functions import crypto

    return crypto.split_batches(X.log_state(spark, sf).where("namespace = 3"))


from . import chunks  # noqa: E402, F401 - registers its queries
