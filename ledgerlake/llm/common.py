"""Shared pieces of the training-data operators: scratch tables, chunked Arrow maps, small Hadoop file helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a Python worker looks at in one go; longer single texts form a chunk of their own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Has Spark send rows to Python in batches of some MB, if the session leaves that at the default (64 MB a batch, of which the JVM and the worker hold several)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a frame reads; 0 if one of them tells no size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else 0


def partitions(docs: DataFrame, factor: float = 1.0, each: int = 64 << 20) -> int:
    """How many partitions rows of about `factor` times the bytes of docs are dealt out to: the session's number, or more, so that one has some `each` bytes."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(input_bytes(docs) * factor) // each, 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session (as in tests) takes a folder in its warehouse; on a cluster that would be each machine's own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; unlike localCheckpoint they survive lost executors.

    drop() removes a table as soon as nothing reads it; the others go when the session's process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        bounded_batches(spark)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            fs, p = hadoop_fs(self.spark, df._scratch_path)
            fs.delete(p, True)
        self.spark._jvm.System.gc()  # so that Spark's cleaner also removes shuffle files of jobs that are over

    def close(self) -> None:
        try:
            fs, p = hadoop_fs(self.spark, self.root)
            fs.delete(p, True)
        except Exception:  # the JVM is gone already: the cluster's own cleaning of the checkpoint folder takes over
            pass


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of a batch with at most `limit` bytes of text each (a longer text alone); null texts read as empty."""
    import numpy as np

    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.type != pa.string():
        text = text.cast(pa.string())
    if text.null_count:
        text = pc.fill_null(text, "")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(text):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(a, b - a), text.slice(a, b - a)
        a = b


#: What the functions of a task keep from chunk to chunk, by name; see kept().
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """Made once in a task, and given back at its end (release())."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Gives memory back at the end of a task. Spark uses a Python worker again for later tasks, so what one of them leaves would be there in all stages to come."""
    import ctypes

    _kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when the task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def over_chunks(f: Callable[[pa.RecordBatch, pa.StringArray], pa.RecordBatch | None], column: str = "text", limit: int = CHUNK_BYTES) -> Callable:
    """A function for mapInArrow that applies f to each slice of bounded text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, column, limit):
                out = f(part, text)
                if out is not None and out.num_rows:
                    yield out

    return run


def raw_texts(text: pa.StringArray) -> list[bytes]:
    return text.cast(pa.binary()).to_pylist()


def documents(df: DataFrame, *more: str) -> DataFrame:
    """The columns that an operator works on; extra columns, whatever their names, stay behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
