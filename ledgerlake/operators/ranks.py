"""Ranks over a whole group without putting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_range(rows: DataFrame, by: str, name: str = "_range") -> DataFrame:
    """rows with the number of the range that holds their value: approximate quantiles cut the values into as many as there
    are shuffle partitions. The quantiles are an action, of bounded result."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = sorted(set(rows.approxQuantile(by, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    cut = F.size(F.filter(F.array(*(F.lit(int(b)) for b in bounds)), lambda b: b < F.col(by))) if bounds else F.lit(0)
    return rows.withColumn(name, cut)


def global_rank(rows: DataFrame, group: str, by: str, name: str = "rk") -> DataFrame:
    """rows with their number, from 0, in the order of `by` (a number) within `group`.

    Rows are numbered within ranges of values, and the sizes of the ranges before are added. A group thus takes as many tasks as its share of rows."""
    ranged = with_range(rows, by)
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = sizes.select(group, "_range", (F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_range").orderBy(by)) - 1)
    return own.join(before, [group, "_range"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
