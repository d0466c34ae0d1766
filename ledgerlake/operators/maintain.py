"""Rewrites: copying live state of listed spaces, with new parameters or keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def repack(state: DataFrame, spaces: list[str]) -> DataFrame:
    """Live rows of the listed spaces; all others are left behind."""
    return state.where(F.col("space_id").isin(spaces))


def rotate(state: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows under their new space ids (old_id, new_id); spaces that aren't listed are dropped."""
    return state.join(mapping, state.space_id == mapping.old_id).drop("space_id", "old_id").withColumnRenamed("new_id", "space_id")


def unreferenced_batches(batches: DataFrame, index: DataFrame) -> DataFrame:
    return batches.select("namespace", "batch_id").distinct().join(index.select("namespace", "batch_id").distinct(), ["namespace", "batch_id"], "left_anti")


def retired_roots(old: DataFrame, kept: DataFrame) -> DataFrame:
    return old.select("root_slot").distinct().join(kept.select("root_slot"), "root_slot", "left_anti")
