"""Manifests: one row for each file, from a tree, from a table of documents, or saved before."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from snapsync.functions import expressions as X
from snapsync.functions.tables import folded, running, written
from snapsync.sources.paths import Path

CONTROL_DIR = ".snapsync"
LONGEST_PATH = 4096


def _listing(uri: str):
    """What folders (dir) hold: path, is_dir, size, mtime_ns; folders behind links are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch["dir"].to_pylist():
                held = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                held = [x for x in held if x.type == fs.FileType.File or (x.type == fs.FileType.Directory and not (local and os.path.islink(x.path)))]
                for low in range(0, len(held), 10_000):
                    part = held[low : low + 10_000]
                    columns = [[x.path for x in part], [x.type == fs.FileType.Directory for x in part], [x.size or 0 for x in part], [x.mtime_ns for x in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "is_dir", "file_size", "mtime_ns"])

    return run


def _contents(uri: str):
    """Rows of files with their content, one at a time; error instead for one that can't be read or is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for i, path in enumerate(batch["path"].to_pylist()):
                data = error = None
                try:
                    with store.open_input_stream(path) as f:
                        data = f.read()
                except OSError as e:
                    error = type(e).__name__
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, 1) for c in ("path", "file_size", "mtime_ns")), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["path", "file_size", "mtime_ns", "content", "error"])

    return run


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """rel_path, file_size, mtime_ns of the regular files below a folder; with content also content_hash, content
    and error: a file that can't be read, or is gone since it was listed, is a row with an error and no content.

    Tasks list folders, one level of the tree after the other; files of no length and hidden ones are files like
    others. root: a path in a folder that all executors share, or the address of a store that pyarrow opens.
    """
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"
    base = fs.FileSystem.from_uri(uri)[1].rstrip("/")
    folders, found = spark.createDataFrame([(base,)], "dir string"), None
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not folders.isEmpty():
        held = written(folders.repartition(parallel, "dir").mapInArrow(_listing(uri), "path string, is_dir boolean, file_size long, mtime_ns long"))
        files = held.where("NOT is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        folders = held.where("is_dir").select(F.col("path").alias("dir"))
    if content:
        found = found.repartition(parallel, "path").mapInArrow(_contents(uri), "path string, file_size long, mtime_ns long, content binary, error string").withColumn("content_hash", F.md5("content"))
    rel = F.substring("path", F.lit(len(base) + 2), F.length("path"))
    return exclude_control_dir(found.select(rel.alias("rel_path"), "file_size", "mtime_ns", *(["content_hash", "content", "error"] if content else [])))


#: What is read at once before rows go on: so many bytes or ranges.
_HELD_BYTES, _HELD_ROWS = 8 << 20, 1000


def _ranges(uri: str, base: str, range_bytes: int, content: bool):
    """Ranges of files, opened once for those that follow each other; error instead for a file that can't be read, is
    gone or has another size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)

        def read(paths: list[str], sizes: list[int], places: list[int]) -> Iterator[tuple]:
            for path, rows in groupby(zip(paths, sizes, places), lambda x: x[0]):
                f = error = None
                try:
                    f = store.open_input_file(f"{base}/{path}")
                    held = f.size()
                except OSError as e:
                    error = type(e).__name__
                try:
                    for _, size, index in rows:
                        data, wrong = None, error
                        if f is not None and error is None:
                            try:
                                data = f.read_at(range_bytes, index * range_bytes) if held == size else None
                                wrong = "Changed" if data is None or len(data) != min(range_bytes, size - index * range_bytes) else None
                            except OSError as e:
                                wrong = type(e).__name__
                        yield (None, None, None, wrong) if wrong else (len(data), hashlib.md5(data, usedforsecurity=False).hexdigest(), data, None)
                finally:
                    if f is not None:
                        f.close()

        kinds = {"raw_len": pa.int64(), "digest": pa.string(), **({"data": pa.binary()} if content else {}), "error": pa.string()}

        def joined(batch: pa.RecordBatch, first: int, rows: list[tuple]) -> pa.RecordBatch:
            columns = [[x[i] for x in rows] for i in ((0, 1, 2, 3) if content else (0, 1, 3))]
            return pa.RecordBatch.from_arrays([*(c.slice(first, len(rows)) for c in batch.columns), *map(pa.array, columns, kinds.values())], [*batch.schema.names, *kinds])

        for batch in batches:
            first, rows, held = 0, [], 0
            for n, *row in read(*(batch[c].to_pylist() for c in ("rel_path", "file_size", "chunk_index"))):
                rows.append((n, *row) if content else (n, row[0], None, row[2]))
                held += (n or 0) if content else 0
                if held >= _HELD_BYTES or len(rows) >= _HELD_ROWS:
                    yield joined(batch, first, rows)
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield joined(batch, first, rows)

    return run


#: Bytes of one file that one task reads together, if ranges are shorter.
_DEALT_BYTES = 1 << 26


def scan_ranges(spark: SparkSession, root: str, range_bytes: int = 1 << 26, content: bool = False) -> DataFrame:
    """rel_path, file_size, mtime_ns, chunk_index, raw_len, digest, error of each range of so many bytes of the files
    below a folder; with content also data.

    Ranges are dealt out by file and place, short ones by some megabytes together, so a file of any size is read by many
    tasks and no cell holds more than a range. A file that can't be read, is gone or has another size than when it was listed gives an error for each range
    that was met so, and no digest. Files of no length have no ranges. root: as for scan_tree().
    """
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"
    base = fs.FileSystem.from_uri(uri)[1].rstrip("/")
    files = scan_tree(spark, root).where("file_size > 0")
    rows = files.withColumn("chunk_index", F.explode(F.expr(f"sequence(0L, (file_size - 1) div {range_bytes})")))
    together = max(1, _DEALT_BYTES // range_bytes)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel_path", F.expr(f"chunk_index div {together}")).sortWithinPartitions("rel_path", "chunk_index")
    return dealt.mapInArrow(_ranges(uri, base, range_bytes, content), f"rel_path string, file_size long, mtime_ns long, chunk_index long, raw_len long, digest string, {'data binary, ' if content else ''}error string")


def exclude_control_dir(manifest: DataFrame, name: str = CONTROL_DIR) -> DataFrame:
    """Drop what lies below the tool's own folder; a null path stays."""
    return manifest.where(~F.coalesce(F.split("rel_path", "/")[0] == name, F.lit(False)))


def from_documents(docs: DataFrame) -> DataFrame:
    """A table of documents as a manifest, with its text as payload."""
    return docs.select(
        (F.col("doc_id") + 1).alias("file_id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("rel_path"),
        F.octet_length("text").cast("long").alias("file_size"),
        (F.lit(1704067200000000000) + F.col("doc_id") * 1000000000).alias("mtime_ns"),
        F.when(F.col("doc_id") % 10 != 9, F.md5("text")).alias("content_hash"),
        "doc_id", "text", "n_chars",
    )


def assign_file_id(manifest: DataFrame) -> DataFrame:
    """file_id from 1 on, in path order."""
    return running(manifest.drop("file_id").withColumn("__one", F.lit(1)), "rel_path", "__one", "__before", "file_id").drop("__one", "__before")


#: Hexadecimal digits of a path's hash that buckets go by: at 10**10 files some hundred rows fall in one of the first
#: level, and 4,096 buckets in one of the next.
LEVELS = (6, 3)


def listed(key: str, value: str) -> Column:
    """The digest of a group's values that aren't null, in the order of the key."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""))


def token(manifest: DataFrame) -> DataFrame:
    """One row: token, n_files. Equal trees have equal tokens, in whatever order rows come.

    Row digests are put in path order within buckets by path hash, the buckets' digests in bucket order within larger
    buckets, and so on; no array holds more than a bucket.
    """
    rows = manifest.select(F.col("rel_path").alias("key"), X.row_digest(F.col("rel_path"), F.col("mtime_ns"), F.col("file_size")).alias("d"), F.md5("rel_path").alias("hash"), F.lit(1).cast("long").alias("n"))
    for digits in LEVELS:
        bucket = F.substring("hash", 1, digits).alias("bucket")
        rows = rows.groupBy(bucket).agg(listed("key", "d").alias("d"), F.sum("n").alias("n")).select(F.col("bucket").alias("key"), "d", F.col("bucket").alias("hash"), "n")
    return rows.agg(listed("key", "d").alias("token"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


class _Listed:
    def __init__(self):
        self.digest, self.last = hashlib.md5(usedforsecurity=False), None

    def add(self, x):
        if x is not None:
            self.digest.update(f"{x}".encode() if self.last is None else f",{x}".encode())
            self.last = x

    def result(self):
        return self.digest.hexdigest(), self.last


def id_tokens(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, token, last: the digest of a key's whole numbers in order, joined by commas, and the last of them.

    The list itself is held nowhere: the numbers are streamed in order through the digest.
    """
    return folded(rows, key, [number], _Listed, [("token", StringType()), ("last", rows.schema[number].dataType)])


def save_manifest(manifest: DataFrame, source_id: str, path: str) -> None:
    """Save under a source id, with the token; the source's former rows go."""
    row = token(manifest)
    out = manifest.crossJoin(F.broadcast(row.select("token"))).withColumn("source_id", F.lit(source_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").option("compression", "zstd").parquet(path)


def load_manifest(spark: SparkSession, source_id: str, path: str, most_rows: int | None = None) -> DataFrame | None:
    """A saved manifest; none if it is missing, not what was saved, or of more rows than are allowed, if so many are."""
    found = spark.read.parquet(path).where(F.col("source_id") == source_id)
    rows = found.drop("token", "source_id")
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("rel_path")).alias("longest"), F.first("token").alias("token")).first()
    if not seen.n or (most_rows is not None and seen.n > most_rows) or seen.longest > LONGEST_PATH or token(rows).first().token != seen.token:
        return None
    return rows


#: Sources that are named in a filter at most; more are joined.
NAMED = 10_000


def save_trees(manifest: DataFrame, tokens: DataFrame, path: str) -> None:
    """Save the manifest (source_id and others) of many sources, and their tokens (source_id, token), below path."""
    for rows, kind in ((manifest, "rows"), (tokens.select("token", "source_id"), "tokens")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").option("compression", "zstd").parquet(f"{path}/{kind}")


def reused_trees(spark: SparkSession, tokens: DataFrame, path: str, scan: Callable[[Column], DataFrame]) -> DataFrame:
    """The manifest of the sources of tokens (source_id, token), with reused: of a source whose token is the saved one,
    the saved rows, without a look at the source; of all others what scan gives.

    scan takes a condition on source_id and gives the manifest of those sources, with the saved manifest's columns. Up
    to NAMED sources are named in it and in the filter of the saved rows, so storage by source is pruned before it is
    listed; more are joined, and pruned as the join runs.
    """
    saved = spark.read.parquet(f"{path}/tokens").select("source_id", F.col("token").alias("saved_token"))
    states = written(tokens.select("source_id", "token").join(saved, "source_id", "left").select("source_id", F.coalesce(F.col("token") == F.col("saved_token"), F.lit(False)).alias("hit")))
    known = spark.read.parquet(f"{path}/rows")
    listed = states.limit(NAMED + 1).collect()
    if len(listed) > NAMED:
        hits, others = (states.where(c).select("source_id") for c in ("hit", "NOT hit"))
        parts = [known.join(hits, "source_id", "left_semi"), scan(F.lit(True)).join(others, "source_id", "left_semi")]
    else:
        named = lambda hit: F.col("source_id").isin([r.source_id for r in listed if r.hit == hit])
        parts = [known.where(named(True)), scan(named(False))]
    return parts[0].withColumn("reused", F.lit(True)).unionByName(parts[1].withColumn("reused", F.lit(False)))


#: Folder of the claims below a table of identities: versions that are handed out once, and what they stand for.
CLAIMS = "_claims"


def _claimed(folder: Path, version: int, name: str) -> bool:
    """Whether the file folder/version, which holds name, is ours: only one of those who try at once gets it.

    The file is written aside and then put in its place, whole, if there is none: by a link where the folder is a local
    or mounted one, else by the store's rename, which must refuse an existing target, as HDFS does.
    """
    target, aside = folder.child(f"{version:012d}"), folder.child(f".{name}")
    aside.write(name)
    return aside.move_if_free(target)


def source_identity(spark: SparkSession, roots: DataFrame, path: str) -> DataFrame:
    """root, source_id: roots without an id get one, which is kept. A null root gets none.

    Runs at once agree, then and later: new ids are written aside and published as the next version of the table, which
    one run only can claim; those that lose read the winner's ids and try again with what still has none. Rows (root,
    source_id, given_at) directly in path count as the first version; of several of a root the first given holds.
    """
    folder = Path(spark, path).child(CLAIMS)
    schema = "root string, source_id string, given_at timestamp"
    wanted = written(roots.select(F.col("root").cast("string").alias("root")).where("root IS NOT NULL").distinct())
    while True:
        versions = folder.names()
        parts = [path] if Path(spark, path).names() else []
        parts += [f"{path}/{CLAIMS}/ids-{folder.child(v).read()}" for v in versions]
        known = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
        first = known.groupBy("root").agg(F.min(F.struct("given_at", "source_id")).alias("first")).select("root", "first.source_id")
        new = wanted.join(first, "root", "left_anti")
        if new.isEmpty():
            return wanted.join(first, "root")
        name = uuid.uuid4().hex
        new.select("root", F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")).alias("source_id"), F.current_timestamp().alias("given_at")).write.parquet(f"{path}/{CLAIMS}/ids-{name}")
        _claimed(folder, int(versions[-1]) + 1 if versions else 0, name)
