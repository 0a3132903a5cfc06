"""Blocks of payloads: digests, comparison, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.functions import expressions as X


def chunk_digests(files: DataFrame, chunk: int, keys: tuple[str, ...] = ("file_id",), weak: bool = False, data: bool = False) -> DataFrame:
    """keys, chunk_index, raw_len, digest of each block of text; cut before any shuffle, so large files spread."""
    body = F.col("text").cast("binary")
    rows = files.where(F.octet_length("text") > 0).withColumn("chunk_index", F.explode(F.expr(f"sequence(0, CAST((octet_length(text) - 1) div {chunk} AS INT))")))
    block = F.substring(body, F.col("chunk_index") * chunk + 1, F.lit(chunk))
    rows = rows.select(*keys, "chunk_index", block.alias("data"))
    more = [X.weak_checksum("data").alias("weak")] if weak else []
    return rows.select(*keys, "chunk_index", F.octet_length("data").cast("long").alias("raw_len"), F.md5("data").alias("digest"), *more, *(["data"] if data else []))


def block_delta(source: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks of source with needed: target's block at the same place has another digest, or there is none."""
    there = target.select("file_id", "chunk_index", F.col("digest").alias("dst_digest"))
    return source.join(there, ["file_id", "chunk_index"], "left").withColumn("needed", F.coalesce(F.col("digest") != F.col("dst_digest"), F.lit(True))).drop("dst_digest")


def needed_chunks(source: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks of source that target lacks, has shorter, or has otherwise."""
    return source.join(target.select("file_id", "chunk_index", "raw_len", "digest"), ["file_id", "chunk_index", "raw_len", "digest"], "left_anti")


def delta_savings(delta: DataFrame) -> DataFrame:
    saved = F.sum(F.when(F.col("needed"), 0).otherwise(F.col("raw_len")))
    return delta.groupBy("file_id").agg(F.sum("raw_len").alias("bytes"), saved.cast("long").alias("bytes_saved"))


def compression_profile(blocks: DataFrame, compressible=None) -> DataFrame:
    """One row: bytes, and bytes sent when a block is encoded only if that makes it smaller (and its file allows it)."""
    allowed = F.lit(True) if compressible is None else compressible
    sent = F.when(allowed, F.least("raw_len", X.encoded_size("data"))).otherwise(F.col("raw_len"))
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("raw_len").alias("raw_bytes"), F.sum(sent).cast("long").alias("sent_bytes"))
