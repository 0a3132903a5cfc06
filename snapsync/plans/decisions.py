"""Which files to copy, and why: two manifests are joined by path, and a CASE decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapsync.functions import expressions as X

MISSING, TOUCHED, CHANGED = 0, 1, 2


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of source with what target has at the same path (null where it has nothing)."""
    there = target.select("rel_path", F.col("file_size").alias("dst_size"), F.col("mtime_ns").alias("dst_mtime_ns"), F.col("content_hash").alias("dst_hash"))
    return source.join(there, "rel_path", "left")


def want_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """source with reason (null: skip) and skipped_by (mtime, digest); first match wins."""
    both = manifest_diff(source, target)
    gone = F.col("dst_size").isNull() | (F.col("dst_size") != F.col("file_size"))
    reason = F.when(gone, MISSING).when(F.col("mtime_ns") == F.col("dst_mtime_ns"), F.lit(None)).when(F.col("content_hash").isNull(), TOUCHED).when(F.col("content_hash") == F.coalesce("dst_hash", F.lit("")), F.lit(None)).otherwise(CHANGED)
    by = F.when(gone, F.lit(None)).when(F.col("mtime_ns") == F.col("dst_mtime_ns"), "mtime").when(F.col("content_hash") == F.col("dst_hash"), "digest")
    return both.withColumn("reason", reason.cast("int")).withColumn("skipped_by", by)


def tiebreak_paths(source: DataFrame, target: DataFrame) -> DataFrame:
    """Paths of equal size and other mtime: the only ones whose content has to be read."""
    both = manifest_diff(source, target)
    return both.where((F.col("dst_size") == F.col("file_size")) & (F.col("mtime_ns") != F.col("dst_mtime_ns"))).select("rel_path")


def hash_tiebreak(source: DataFrame, target: DataFrame, contents: DataFrame) -> DataFrame:
    """rel_path, dst_digest for the paths in doubt; contents (rel_path, text) is read for these alone."""
    doubt = tiebreak_paths(source, target)
    return contents.join(doubt, "rel_path", "left_semi").select("rel_path", F.md5("text").alias("dst_digest"))


def sync_plan(source: DataFrame, target: DataFrame, index: DataFrame) -> DataFrame:
    """source with action (SKIP, FULL, PARTIAL), resume_offset and same_size; index: file_id, received_bytes.

    Unsafe paths are in no plan (quarantine() shows them). Contents (text) are read only of files without a digest that
    have the target's size and another time.
    """
    both = manifest_diff(source.drop("text"), target).where(X.unsafe_reason(F.col("rel_path")).isNull()).join(index.select("file_id", "received_bytes"), "file_id", "left")
    digest = F.col("content_hash")
    if "text" in source.columns:
        doubt = both.where((F.col("dst_size") == F.col("file_size")) & (F.col("mtime_ns") != F.col("dst_mtime_ns")) & F.col("content_hash").isNull()).select("file_id")
        read = source.select("file_id", "text").join(doubt, "file_id", "left_semi").select("file_id", F.md5("text").alias("read_hash"))
        both, digest = both.join(read, "file_id", "left"), F.coalesce("content_hash", "read_hash")
    got = F.coalesce("received_bytes", F.lit(0))
    missing, other = F.col("dst_size").isNull(), F.col("dst_size") != F.col("file_size")
    partial = ~missing & other & (got > 0) & (got < F.col("file_size"))
    same = ~missing & ~other & ((F.col("mtime_ns") == F.col("dst_mtime_ns")) | (digest == F.col("dst_hash")))
    action = F.when(missing, "FULL").when(partial, "PARTIAL").when(other, "FULL").when(same, "SKIP").otherwise("FULL")
    rows = both.withColumn("action", action).withColumn("resume_offset", F.when(F.col("action") == "PARTIAL", got).otherwise(0).cast("long"))
    return rows.withColumn("same_size", ~missing & ~other)


def delta_candidates(plan: DataFrame, least: int = X.SMALL_FILE) -> DataFrame:
    """Files of the same size whose content differs, worth comparing block by block."""
    return plan.where((F.col("action") == "FULL") & F.col("same_size") & (F.col("file_size") > least))


def drop_skipped(source: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows that the plan doesn't skip; what it doesn't name is sent."""
    return source.join(plan.where(F.col("action") == "SKIP").select("file_id"), "file_id", "left_anti")


def quarantine(manifest: DataFrame) -> DataFrame:
    """manifest with rejected (why a path is unsafe; null for good rows)."""
    return manifest.withColumn("rejected", X.unsafe_reason(F.col("rel_path")))


def orphans(source: DataFrame, target: DataFrame) -> DataFrame:
    return target.join(source.select("rel_path"), "rel_path", "left_anti")


def resolve_wants(wants: DataFrame, source: DataFrame) -> DataFrame:
    """wants with their files, and known = false for ids that no file has."""
    return wants.join(source.withColumn("known", F.lit(True)), "file_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def token_hit(tokens: DataFrame, cached: DataFrame) -> DataFrame:
    """Sources with hit: the cache holds the same token."""
    held = cached.select("source_id", "token").distinct().withColumn("hit", F.lit(True))
    return tokens.join(held, ["source_id", "token"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def choose_mode(targets: DataFrame, progress: DataFrame, cached: DataFrame) -> DataFrame:
    """targets (source_id) with mode: resume if progress is kept, else incremental if a tree is cached, else full."""
    has = lambda df, name: df.select("source_id").distinct().withColumn(name, F.lit(True))
    both = targets.join(has(progress, "p"), "source_id", "left").join(has(cached, "c"), "source_id", "left")
    return both.withColumn("mode", F.when(F.col("p"), "resume").when(F.col("c"), "incremental").otherwise("full")).drop("p", "c")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(state: DataFrame, updates: DataFrame) -> DataFrame:
    """State of files after updates: the latest updated_at of each file_id; received_bytes null removes it."""
    return first_by(state.unionByName(updates), ["file_id"], [F.col("updated_at").desc(), F.col("received_bytes").desc()]).where(F.col("received_bytes").isNotNull())
