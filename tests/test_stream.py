"""A growing log as a structured stream."""

from pyspark.sql import functions as F

from ledgerlake.streaming import pages


def test_stream_reads_each_record_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    for k in range(3):
        rows = spark.range(k * 10, k * 10 + 10).select(F.lit(3).cast("smallint").alias("namespace"), F.col("id").alias("log_id"), F.col("id").cast("string").cast("binary").alias("payload"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    q = pages.stream(spark, folder).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.log_id for r in spark.sql("SELECT log_id FROM seen").collect()) == list(range(30))
    assert len(q.recentProgress) >= 3
