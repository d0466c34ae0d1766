"""Folding a journal into state: last write wins in the order of (seq, op_ord).

One aggregation, combined before the shuffle; a hot key sends one row a task. The winner is held in a struct, so a
tombstone's null value can win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranks import with_range

KEYS = ("namespace", "key")


def winners(ops: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last operation on each key, tombstones included."""
    best = F.max_by(F.struct("value", "is_delete", "seq", "op_ord"), F.struct("seq", "op_ord"))
    return ops.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.value", "w.is_delete", "w.seq", "w.op_ord")


def fold(ops: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """State after all operations."""
    return winners(ops, keys).where("not is_delete").drop("is_delete")


def apply(base: DataFrame, ops: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Base state with operations applied: a full outer join on the key."""
    last = winners(ops, keys).select(*keys, F.col("value").alias("new"), F.col("is_delete").alias("gone"))
    joined = base.join(last, list(keys), "full_outer")
    return joined.where("gone is null or not gone").select(*keys, F.when(F.col("gone").isNull(), F.col("value")).otherwise(F.col("new")).alias("value"))


def erase(state: DataFrame, namespace: int) -> DataFrame:
    """State without a namespace."""
    return state.where(F.col("namespace") != namespace)


def carry_forward(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Roots of a new version: those of touched namespaces from the new ones, all others as they were."""
    return prior.join(new.select("namespace"), "namespace", "left_anti").unionByName(new)


def out_of_order(rows: DataFrame, by: str = "key") -> DataFrame:
    """Neighbours in row order (`ord`) within a namespace whose keys don't rise: there should be none.

    Rows are looked at in ranges of `ord`, and each range hands its last key on to the next, so no namespace is in one task."""
    ranged = with_range(rows, "ord")
    here = Window.partitionBy("namespace", "_range").orderBy("ord")
    last = rows_last(ranged, by)
    told = ranged.withColumn("_lag", F.lag(by).over(here)).join(last, ["namespace", "_range"], "left")
    before = F.when(F.row_number().over(here) == 1, F.col("_before")).otherwise(F.col("_lag"))
    return told.withColumn("_prior", before).where(F.col("_prior") >= F.col(by)).select(*rows.columns)


def rows_last(ranged: DataFrame, by: str) -> DataFrame:
    """For each range of a namespace the key that comes right before it: as many rows as ranges."""
    ends = ranged.groupBy("namespace", "_range").agg(F.max_by(by, "ord").alias("_end"))
    return ends.select("namespace", "_range", F.lag("_end").over(Window.partitionBy("namespace").orderBy("_range")).alias("_before"))


def invalid(ops: DataFrame) -> DataFrame:
    """Operations that break a limit: namespace 1-255, keys of 1-256 bytes, values up to 2048."""
    bad = F.when((F.col("namespace") < 1) | (F.col("namespace") > 255), "namespace").when(~F.octet_length("key").between(1, 256), "key").when(F.octet_length("value") > 2048, "value")
    return ops.withColumn("reason", bad).where("reason is not null")
