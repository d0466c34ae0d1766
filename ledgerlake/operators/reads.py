"""Ordered reads. Frames are lazy; filters on namespace and on the key or id reach the Parquet scan, pages plan as top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def get(kv: DataFrame, namespace: int, key: bytes) -> DataFrame:
    """The value of a key: one row or none."""
    return kv.where((F.col("namespace") == namespace) & (F.col("key") == F.lit(bytearray(key)))).select("value")


def list_all(kv: DataFrame, namespace: int) -> DataFrame:
    return kv.where(F.col("namespace") == namespace).select("key", "value").orderBy("key")


def list_after(kv: DataFrame, namespace: int, after: bytes | None, limit: int) -> DataFrame:
    """At most `limit` entries with keys above the cursor, in order; from the start without one."""
    rows = kv.where(F.col("namespace") == namespace)
    if after is not None:
        rows = rows.where(F.col("key") > F.lit(bytearray(after)))
    return rows.select("key", "value").orderBy("key").limit(limit)


def list_keys(kv: DataFrame, namespace: int) -> DataFrame:
    return kv.where(F.col("namespace") == namespace).select("key").orderBy("key")


def list_keys_after(kv: DataFrame, namespace: int, after: bytes | None, limit: int) -> DataFrame:
    rows = kv.where(F.col("namespace") == namespace)
    if after is not None:
        rows = rows.where(F.col("key") > F.lit(bytearray(after)))
    return rows.select("key").orderBy("key").limit(limit)


def count(state: DataFrame, namespace: int) -> DataFrame:
    return state.where(F.col("namespace") == namespace).agg(F.count("*").alias("n"))


def read_log(log: DataFrame, namespace: int, log_id: int) -> DataFrame:
    return log.where((F.col("namespace") == namespace) & (F.col("log_id") == log_id)).select("payload")


def iter_log(log: DataFrame, namespace: int) -> DataFrame:
    return log.where(F.col("namespace") == namespace).select("log_id", "payload").orderBy("log_id")


def log_after(log: DataFrame, namespace: int, after: int | None, limit: int) -> DataFrame:
    """Oldest first: records with ids above the cursor."""
    rows = log.where(F.col("namespace") == namespace)
    if after is not None:
        rows = rows.where(F.col("log_id") > after)
    return rows.select("log_id", "payload").orderBy("log_id").limit(limit)


def log_before(log: DataFrame, namespace: int, before: int | None, limit: int) -> DataFrame:
    """Newest first: records with ids below the cursor."""
    rows = log.where(F.col("namespace") == namespace)
    if before is not None:
        rows = rows.where(F.col("log_id") < before)
    return rows.select("log_id", "payload").orderBy(F.desc("log_id")).limit(limit)


def log_range(log: DataFrame, namespace: int, start: int, end: int, limit: int) -> DataFrame:
    """Records with start <= id < end, oldest first."""
    rows = log.where((F.col("namespace") == namespace) & (F.col("log_id") >= start) & (F.col("log_id") < end))
    return rows.select("log_id", "payload").orderBy("log_id").limit(limit)


def resolve(index: DataFrame, batches: DataFrame) -> DataFrame:
    """Payloads of index entries (namespace, log_id, batch_id) from batches of records; of repeated ids in a batch the last counts."""
    records = batches.select("namespace", "batch_id", F.posexplode("records").alias("pos", "r")).select("namespace", "batch_id", "pos", F.col("r.log_id").alias("log_id"), F.col("r.payload").alias("payload"))
    last = records.groupBy("namespace", "batch_id", "log_id").agg(F.max_by(F.struct("payload"), "pos").alias("p"))
    return index.join(last, ["namespace", "batch_id", "log_id"]).select("namespace", "log_id", "batch_id", F.col("p.payload").alias("payload"))


def unresolved(index: DataFrame, batches: DataFrame) -> DataFrame:
    """Index entries whose batch lacks the record: there should be none."""
    records = batches.select("namespace", "batch_id", F.explode("records.log_id").alias("log_id"))
    return index.join(records, ["namespace", "batch_id", "log_id"], "left_anti").select("namespace", "log_id", "batch_id")
