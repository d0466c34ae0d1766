"""Catalog, statistics and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HORIZON = 1024


def namespaces(kv: DataFrame, log: DataFrame) -> DataFrame:
    """Namespaces that have data, with kind and number of entries."""
    one = kv.groupBy("namespace").agg(F.lit("Kv").alias("kind"), F.count("*").alias("n"))
    return one.unionByName(log.groupBy("namespace").agg(F.lit("Log").alias("kind"), F.count("*").alias("n"))).orderBy("namespace")


def stats(catalog: DataFrame, owned: int, total: int) -> DataFrame:
    """One row: number of namespaces, entries, utilisation, counts by namespace."""
    counts = F.array_sort(F.collect_list(F.struct("namespace", F.col("n").alias("count"))))
    return catalog.agg(F.count("*").alias("namespaces"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), utilization(F.lit(owned), F.lit(total)).alias("utilization"), counts.alias("namespace_counts"))


def utilization(owned: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(owned.cast("double") / F.nullif(total, F.lit(0)))


def newest(superblocks: DataFrame) -> DataFrame:
    """The decodable record with the highest seq; of equal ones the last slot."""
    best = F.max_by(F.struct("seq", "slot", "root_seq"), F.struct("seq", "slot"))
    return superblocks.where("decodable and root_seq = seq").agg(best.alias("w")).select("w.*")


def newer_unreadable(superblocks: DataFrame) -> DataFrame:
    """The highest seq that can't be read, if above the chosen one."""
    told = superblocks.agg(F.max(F.when(~F.col("decodable"), F.col("seq"))).alias("unreadable"), F.max(F.when(F.col("decodable"), F.col("seq"))).alias("chosen"))
    return told.select("chosen", F.when(F.col("unreadable") > F.col("chosen"), F.col("unreadable")).alias("newer_unreadable"))


def history(commits: DataFrame) -> DataFrame:
    return commits.agg(F.array_sort(F.collect_set("seq")).alias("history"))


def within_horizon(commits: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Versions that are kept: the newest and those up to `horizon` before it."""
    return commits.join(F.broadcast(commits.agg(F.max("seq").alias("newest"))), F.col("seq") >= F.col("newest") - horizon).drop("newest")


def triage(current: Column, anchor: Column, history: Column, horizon: int = HORIZON) -> Column:
    """What an anchor that a host kept says about the current version. The order of the tests matters."""
    return F.when(current < anchor, "rollback").when(F.array_contains(history, anchor), "clean").when(current - anchor > horizon, "out_of_range").otherwise("fork")
