"""The engine's two record shapes over the relational tables: key/value entries, log records, and a journal of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS, CONTACTS, MESSAGE_LOG, MEDIA, EVENT_LOG, PROFILE = 1, 2, 3, 4, 5, 6
KINDS = {SETTINGS: "Kv", CONTACTS: "Kv", MESSAGE_LOG: "Log", MEDIA: "Kv", EVENT_LOG: "Log", PROFILE: "Kv"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kv(df: DataFrame, namespace: int, key, value) -> DataFrame:
    return df.select(F.lit(namespace).cast("smallint").alias("namespace"), key.cast("binary").alias("key"), value.cast("binary").alias("value"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(table(spark, sf_dir, "region"), SETTINGS, F.col("r_name"), F.col("r_regionkey").cast("string"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(table(spark, sf_dir, "customer"), CONTACTS, F.col("c_name"), F.col("c_mktsegment"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in slices of 2048 bytes under the hash of the whole and the slice's number; equal texts are stored once."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    sliced = docs.select(F.sha2("b", 256).alias("h"), "b").dropDuplicates(["h"]).select("h", "b", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("b") / 2048).cast("int") - 1, F.lit(0)))).alias("i"))
    return _kv(sliced, MEDIA, F.concat("h", F.lpad(F.col("i").cast("string"), 8, "0")), F.expr("substring(b, i * 2048 + 1, 2048)"))


def _log(df: DataFrame, namespace: int, log_id, payload) -> DataFrame:
    return df.select(F.lit(namespace).cast("smallint").alias("namespace"), log_id.cast("long").alias("log_id"), payload.cast("binary").alias("payload"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(table(spark, sf_dir, "conversations"), MESSAGE_LOG, F.col("conv_id") * 65536 + F.col("turn"), F.col("text"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return _log(table(spark, sf_dir, "events"), EVENT_LOG, F.floor(micros / 1000) * 1048576 + F.col("event_id"), F.col("props"))


def profile_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal: seq, op_ord, namespace, key, value, is_delete."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = events.agg(F.min("day").alias("first"))
    joined = events.join(F.broadcast(first))  # one row
    gone = F.col("event_type") == "error"
    return joined.select((F.datediff("day", "first") + 2).cast("long").alias("seq"), F.col("event_id").alias("op_ord"), F.lit(PROFILE).cast("smallint").alias("namespace"), F.col("user_id").cast("string").cast("binary").alias("key"), F.when(~gone, F.col("event_type")).cast("binary").alias("value"), gone.alias("is_delete"))


def kv_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings(spark, sf_dir).union(contacts(spark, sf_dir))


def log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).union(event_log(spark, sf_dir))
