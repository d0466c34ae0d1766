"""Bounded pages over a log, one job a page. Cursors are exclusive; the stream ends at the first empty page.

By default all pages come from the frame given, one snapshot. With live=True the argument is a function that gives the
current frame, asked for each page, so records appended beyond the cursor appear."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, functions as F

from ..operators import reads
from ..operators.ranks import global_rank

Source = DataFrame | Callable[[], DataFrame]


def _now(source: Source) -> DataFrame:
    return source() if callable(source) else source


def pages_after(source: Source, namespace: int, after: int | None, size: int) -> Iterator[list[Row]]:
    while size > 0 and (page := reads.log_after(_now(source), namespace, after, size).collect()):
        yield page
        after = page[-1].log_id


def pages_before(source: Source, namespace: int, before: int | None, size: int) -> Iterator[list[Row]]:
    while size > 0 and (page := reads.log_before(_now(source), namespace, before, size).collect()):
        yield page
        before = page[-1].log_id


def range_pages(source: Source, namespace: int, start: int, end: int, size: int) -> Iterator[list[Row]]:
    """Pages of start <= id < end; ends safely at the largest id."""
    while size > 0 and start < end and (page := reads.log_range(_now(source), namespace, start, end, size).collect()):
        yield page
        start = page[-1].log_id + 1


def page_table(log: DataFrame, namespace: int, size: int, after: int | None = None, before: int | None = None, backward: bool = False) -> DataFrame:
    """log_id and page: which page of a stream between two exclusive cursors has each record. The pages as one lazy table, for consumers that read many of them: ranks are numbered in ranges, no page comes to the driver."""
    rows = log.where(F.col("namespace") == namespace)
    if after is not None:
        rows = rows.where(F.col("log_id") > after)
    if before is not None:
        rows = rows.where(F.col("log_id") < before)
    rows = rows.select("namespace", (-F.col("log_id") if backward else F.col("log_id")).alias("at"))
    ranked = global_rank(rows, "namespace", "at")
    return ranked.select((-F.col("at") if backward else F.col("at")).alias("log_id"), F.floor(F.col("rk") / size).alias("page"))


def stream(spark, path: str, schema: str = "namespace smallint, log_id long, payload binary", files_per_batch: int = 1) -> DataFrame:
    """A growing folder of log records as a structured stream, a few files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
