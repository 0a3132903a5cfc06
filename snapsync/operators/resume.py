"""What is done of a transfer, and what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapsync.functions.tables import written


def valid_progress(progress: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of progress (token, total_chunks, chunk_id) that belong to the current (token, total_chunks)."""
    return progress.join(current.select("token", "total_chunks").distinct(), ["token", "total_chunks"]).select("chunk_id").distinct()


def chunks_remaining(chunks: DataFrame, done: DataFrame) -> DataFrame:
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def remark_corrupt(remaining: DataFrame, spans: DataFrame, bad: DataFrame) -> DataFrame:
    """Chunks left, with all that bad files lie in."""
    again = spans.join(bad.select("file_id").distinct(), "file_id", "left_semi").select("chunk_id")
    return remaining.select("chunk_id").unionByName(again).distinct()


def file_completion(spans: DataFrame, done: DataFrame) -> DataFrame:
    """file_id, chunks_needed, chunks_done, complete."""
    marked = spans.select("file_id", "chunk_id").distinct().join(done.select("chunk_id").distinct().withColumn("d", F.lit(1)), "chunk_id", "left")
    return marked.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks_needed"), F.count("d").alias("chunks_done")).withColumn("complete", F.col("chunks_needed") == F.col("chunks_done"))


def arrivals_completion(arrivals: DataFrame, needed) -> DataFrame:
    """file_id, n_chunks, complete from arrivals in any order; repeats count once."""
    return arrivals.groupBy("file_id").agg(F.countDistinct("chunk_index").alias("n_chunks")).withColumn("complete", F.col("n_chunks") >= needed)


def progress_summary(sizes: DataFrame, done: DataFrame) -> DataFrame:
    """One row: chunks done and left, bytes done, percent; sizes: chunk_id, raw_size."""
    both = sizes.join(done.select("chunk_id").distinct().withColumn("d", F.lit(True)), "chunk_id", "left")
    got = F.coalesce(F.sum(F.when(F.col("d"), F.col("raw_size"))), F.lit(0)).cast("long")
    return both.agg(F.count("d").alias("chunks_done"), (F.count(F.lit(1)) - F.count("d")).alias("chunks_left"), got.alias("bytes_done"), (100.0 * got / F.sum("raw_size")).alias("percent"))


def to_bitmap(done: DataFrame) -> DataFrame:
    """bucket, bits of chunk ids: one row for 32,768 chunks."""
    id_ = F.col("chunk_id") + 1  # positions count from 1
    return done.groupBy(F.bitmap_bucket_number(id_).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("bits"))


def from_bitmap(bitmaps: DataFrame) -> DataFrame:
    """chunk_id of each set bit, lowest bit first within a byte."""
    byte = F.conv(F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    rows = bitmaps.select("bucket", "bits", F.explode(F.expr("sequence(0, octet_length(bits) - 1)")).alias("at")).select("bucket", "at", byte.alias("byte")).where("byte > 0")
    rows = rows.withColumn("bit", F.explode(F.expr("sequence(0, 7)"))).where("(shiftright(byte, bit) & 1) = 1")
    return rows.select(((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("bit")).cast("long").alias("chunk_id"))


def retry_failed(work: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, times: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows that succeeded, rows left) after up to so many attempts, the first and three more; attempt gives rows with ok."""
    left, done = work, None
    for n in range(times):
        tried = written(attempt(left, n))
        good = tried.where("ok")
        done = good if done is None else done.unionByName(good)
        left = left.join(good.select(key), key, "left_anti")
        if left.isEmpty():
            break
    return done, left


def save_progress(done: DataFrame, token: str, total_chunks: int, path: str) -> None:
    """Save the chunks that are done (chunk_id) of a layout, as bitmaps; what was saved under its token goes."""
    rows = to_bitmap(done).withColumn("total_chunks", F.lit(total_chunks).cast("long")).withColumn("token", F.lit(token))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("token").parquet(path)


def load_progress(spark: SparkSession, token: str, total_chunks: int, path: str) -> DataFrame:
    """chunk_id of the chunks that are done; none if what was saved is of another layout, or names chunks beyond it."""
    saved = spark.read.parquet(path).where((F.col("token") == token) & (F.col("total_chunks") == total_chunks))
    return from_bitmap(saved.select("bucket", "bits")).where(F.col("chunk_id").between(0, total_chunks - 1))
