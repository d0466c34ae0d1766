"""Set algebra over slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ranks import global_rank


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("slot").union(b.select("slot")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("slot").distinct().join(b.select("slot"), "slot", "left_anti")


def members(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("slot"), "slot", "left_semi")


def below_and_unowned(pool: DataFrame, owned: DataFrame, high_water: int) -> DataFrame:
    return pool.where(F.col("slot") < high_water).join(owned.select("slot"), "slot", "left_anti").select("slot")


def rank_select(a: DataFrame, r: int) -> DataFrame:
    """The member with r smaller ones, none if there aren't as many; numbered in ranges, whatever r is."""
    return global_rank(a.select("slot", F.lit(0).alias("_one")).distinct(), "_one", "slot").where(F.col("rk") == r).select("slot")


def sample(a: DataFrame, n: int, seed: int) -> DataFrame:
    """n members drawn without replacement; the same ones for a seed."""
    return a.select("slot").distinct().orderBy(F.md5(F.concat_ws(":", "slot", F.lit(seed)).cast("binary")), "slot").limit(n)


def garbage(spark: SparkSession, first_slot: int, n: int, size: int = 4056) -> DataFrame:
    """n chunks of random bytes: slot, payload."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(-(-size // 32))), lambda i: F.sha2(F.concat_ws(":", F.uuid(), i).cast("binary"), 256)), "")
    return spark.range(first_slot, first_slot + n).select(F.col("id").alias("slot"), F.substring(F.unhex(words), 1, size).alias("payload"))


def numbered_pages(a: DataFrame, by: str, size: int) -> DataFrame:
    """Page of each row in the order of `by` within its namespace, to check cursor pages against."""
    return global_rank(a, "namespace", by, "_rank").withColumn("page", F.floor(F.col("_rank") / size)).drop("_rank")
