"""Virtual archive: all files end to end in path order, cut in chunks of one size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.functions.tables import running


def virtual_layout(manifest: DataFrame) -> DataFrame:
    """manifest with virtual_offset and place (from 1) in path order."""
    return running(manifest, "rel_path", "file_size", "virtual_offset", "place")


def archive_spans(layout: DataFrame, chunk: int) -> DataFrame:
    """chunk_id, file_id, chunk_rel, file_offset, length: the parts of files in each chunk; each file is cut by itself."""
    size, start = F.col("file_size"), F.col("virtual_offset")
    cut = layout.where(size > 0).withColumn("chunk_id", F.explode(F.expr(f"sequence(virtual_offset div {chunk}, (virtual_offset + file_size - 1) div {chunk})")))
    low, high = F.greatest(start, F.col("chunk_id") * chunk), F.least(start + size, (F.col("chunk_id") + 1) * chunk)
    return cut.select("chunk_id", "file_id", (low - F.col("chunk_id") * chunk).alias("chunk_rel"), (low - start).alias("file_offset"), (high - low).alias("length"), "file_size")


def chunk_sizes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("chunk_id").agg(F.sum("length").alias("raw_size"))


def chunks_per_file(layout: DataFrame, chunk: int) -> DataFrame:
    last = F.expr(f"(virtual_offset + file_size - 1) div {chunk} - virtual_offset div {chunk} + 1")
    return layout.select("file_id", F.when(F.col("file_size") == 0, 0).otherwise(last).cast("long").alias("chunks_needed"))


def skipped_chunks(spans: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: chunks, bytes and finished files of the chunks that nobody asked for."""
    rest = spans.join(requested.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return rest.agg(F.countDistinct("chunk_id").alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.col("file_offset") + F.col("length") == F.col("file_size")).alias("files_ended"))


def lanes(layout: DataFrame, n: int) -> DataFrame:
    """layout with a lane for each file, dealt out in turn; with more than one, lane 0 is for control."""
    lane = F.pmod(F.col("place") - 1, F.lit(n)) if n == 1 else F.pmod(F.col("place") - 1, F.lit(n - 1)) + 1
    return layout.withColumn("lane", lane.cast("int"))
