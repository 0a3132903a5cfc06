"""Manifests kept as trees of digests: brought up to date where rows change, compared from the top down.

Below a folder stand the rows, the digests of their buckets, and those of the larger buckets above (tops), at the levels
of manifests.token, whose token follows from the tops alone. Rows and buckets are stored by the first digits of their
path's hash, so work on a few buckets reads and writes a few folders.

Results for odd input: rows with a null path are left out; sizes and times are compared as the token sees them, so a
file whose content alone differs is no change; an empty manifest gives an empty tree; further columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapsync.functions import expressions as X
from snapsync.functions.tables import written
from snapsync.sources.manifests import LEVELS, listed

#: Digits of a path's hash that folders go by: 256 folders. A folder is the least that an update writes.
FOLDER_DIGITS = 2
_ROWS = "rel_path string, file_size long, mtime_ns long, gone boolean, bucket string, folder string"
_BUCKETS = "bucket string, d string, n long, folder string"
_TOPS = "bucket string, d string, n long"


def _placed(rows: DataFrame) -> DataFrame:
    """rows (rel_path, file_size, mtime_ns, gone) with their bucket and folder."""
    known = rows.where("rel_path IS NOT NULL").select("rel_path", F.col("file_size").cast("long").alias("file_size"), F.col("mtime_ns").cast("long").alias("mtime_ns"), "gone")
    bucket = F.substring(F.md5("rel_path"), 1, LEVELS[0])
    return known.withColumn("bucket", bucket).withColumn("folder", F.substring("bucket", 1, FOLDER_DIGITS))


def _bucket_digests(rows: DataFrame) -> DataFrame:
    """Digests of buckets over rows that aren't gone; a bucket of which all are gone has n = 0."""
    live = F.when(~F.col("gone"), X.row_digest(F.col("rel_path"), F.col("mtime_ns"), F.col("file_size")))
    return rows.withColumn("d", live).groupBy("folder", "bucket").agg(listed("rel_path", "d").alias("d"), F.count_if(~F.col("gone")).alias("n")).select("bucket", "d", "n", "folder")


def _top_digests(buckets: DataFrame) -> DataFrame:
    top = F.substring("bucket", 1, LEVELS[1]).alias("top")
    return buckets.where("n > 0").groupBy(top).agg(listed("bucket", "d").alias("d"), F.sum("n").alias("n")).withColumnRenamed("top", "bucket")


def _save(df: DataFrame, path: str, mode: str) -> None:
    """Whole folders of df, in the order of buckets, so that a reader of few buckets skips most row groups."""
    rows = df.repartition("folder").sortWithinPartitions("folder", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("folder").option("compression", "zstd").parquet(path)


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{kind}")


def save_tree(manifest: DataFrame, path: str) -> None:
    """Save a manifest (rel_path, file_size, mtime_ns) below path, in place of what was there."""
    spark = manifest.sparkSession
    _save(_placed(manifest.withColumn("gone", F.lit(False))), f"{path}/rows", "static")
    _save(_bucket_digests(_read(spark, path, "rows", _ROWS)), f"{path}/buckets", "static")
    # repartition, not coalesce, which would make the sums over all buckets one task.
    _top_digests(_read(spark, path, "buckets", _BUCKETS)).repartition(1).write.mode("overwrite").parquet(f"{path}/tops")


def update_tree(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Bring a tree up to date: rows of changes replace those of their paths, or take them out where gone is true.

    Changes name each path once. Only folders of changed paths are read and written. Rows come first, digests after; an
    update that was cut off is made whole by running it again. Rows taken out stay as such until the tree is saved anew.
    """
    new = written(_placed(changes.withColumn("gone", F.coalesce("gone", F.lit(False)))))
    folders = [r.folder for r in new.select("folder").distinct().collect()]  # 256 at most
    touched = F.col("folder").isin(folders)
    kept = _read(spark, path, "rows", _ROWS).where(touched).join(new.select("rel_path"), "rel_path", "left_anti")
    _save(written(kept.unionByName(new)), f"{path}/rows", "dynamic")
    _save(_bucket_digests(_read(spark, path, "rows", _ROWS).where(touched)), f"{path}/buckets", "dynamic")
    others = _read(spark, path, "tops", _TOPS).where(~F.substring("bucket", 1, FOLDER_DIGITS).isin(folders))
    tops = written(others.unionByName(_top_digests(_read(spark, path, "buckets", _BUCKETS).where(touched))))
    tops.coalesce(1).write.mode("overwrite").parquet(f"{path}/tops")


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, file_size, mtime_ns of a tree."""
    return _read(spark, path, "rows", _ROWS).where(~F.col("gone")).select("rel_path", "file_size", "mtime_ns")


def kept_token(spark: SparkSession, path: str) -> DataFrame:
    """token, n_files of a tree, as manifests.token gives them; only the tops are read."""
    return _read(spark, path, "tops", _TOPS).agg(listed("bucket", "d").alias("token"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """bucket: those whose digests differ, or that one side doesn't have."""
    both = one.select("bucket", F.col("d").alias("one")).join(two.select("bucket", F.col("d").alias("two")), "bucket", "full")
    return both.where(~F.col("one").eqNullSafe(F.col("two"))).select("bucket")


def tree_changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """rel_path, change (added, removed, changed), old_size, old_mtime_ns, file_size, mtime_ns between two trees.

    Tops are compared first, then buckets below those that differ, then rows of buckets that differ; folders without
    any are never opened.
    """
    tops = [r.bucket for r in _differing(*(_read(spark, p, "tops", _TOPS) for p in (before, after))).collect()]  # 4,096 at most
    within: Column = F.col("folder").isin(sorted({t[:FOLDER_DIGITS] for t in tops})) & F.substring("bucket", 1, LEVELS[1]).isin(tops)
    buckets = written(_differing(*(_read(spark, p, "buckets", _BUCKETS).where(within).where("n > 0") for p in (before, after))))
    sides = (_read(spark, p, "rows", _ROWS).where(within).where(~F.col("gone")).join(buckets, "bucket", "left_semi") for p in (before, after))
    old, new = (x.select("rel_path", F.col("file_size").alias(s), F.col("mtime_ns").alias(t), F.lit(True).alias(h)) for x, s, t, h in zip(sides, ("old_size", "file_size"), ("old_mtime_ns", "mtime_ns"), ("was", "is")))
    both = old.join(new, "rel_path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~(F.col("old_size").eqNullSafe(F.col("file_size")) & F.col("old_mtime_ns").eqNullSafe(F.col("mtime_ns"))), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("rel_path", "change", "old_size", "old_mtime_ns", "file_size", "mtime_ns")
