"""Putting files together from blocks, and checking them."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.functions import expressions as X
from snapsync.functions.tables import written


def assemble(blocks: DataFrame) -> DataFrame:
    """file_id, content from blocks (file_id, chunk_index, data) in any order; for files that fit a cell."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "data")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["data"])), ""))
    return blocks.dropDuplicates(["file_id", "chunk_index"]).groupBy("file_id").agg(joined.alias("content"))


def verify_files(expected: DataFrame, assembled: DataFrame) -> DataFrame:
    """file_id, status: ok, mismatch or missing; expected: file_id, digest, and file_size where it is known.

    A file of no length has no blocks: it counts as put together, with no content.
    """
    nothing = F.md5(F.lit(""))
    empty = F.col("file_size") == 0 if "file_size" in expected.columns else F.col("digest") == nothing
    got = assembled.select("file_id", F.md5("content").alias("got"))
    return expected.join(got, "file_id", "left").withColumn("got", F.coalesce("got", F.when(empty, nothing))).select("file_id", F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("digest"), "ok").otherwise("mismatch").alias("status"))


#: Digests that a node of a file's digest tree stands for, and the tree's height: files of up to FAN**HEIGHT blocks.
FAN, HEIGHT = 1024, 3


def file_digests(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """file_id, tree, n_blocks, n_bytes, whole from block digests (file_id, chunk_index, raw_len, digest).

    tree: the root of a tree of fixed height over a file's blocks, each node the digest of its children's in order. No
    row holds more than fan digests, so a file of any size is digested where its blocks are, over many tasks. whole: the
    blocks are those from 0 on without a gap. Repeated blocks count once; of different ones in one place the least
    digest counts, and the file isn't whole.
    """
    at = ["file_id", "chunk_index"]
    rows = blocks.groupBy(*at).agg(F.min("digest").alias("digest"), F.max("digest").alias("other"), F.max("raw_len").alias("bytes"))
    rows = rows.select("file_id", F.col("chunk_index").cast("long").alias("place"), "digest", F.lit(1).cast("long").alias("n"), "bytes", (F.col("digest") == F.col("other")).alias("one"), F.col("chunk_index").cast("long").alias("last"), F.col("chunk_index").cast("long").alias("first"))
    for _ in range(HEIGHT):
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))
        rows = rows.groupBy("file_id", F.floor(F.col("place") / fan).alias("up")).agg(
            F.md5(F.array_join(F.transform(children, lambda x: x["digest"]), "")).alias("digest"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bool_and("one").alias("one"), F.max("last").alias("last"), F.min("first").alias("first")
        ).withColumnRenamed("up", "place")
    # A file beyond the tree's height has more than one root, which no expected digest equals.
    roots = rows.groupBy("file_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("digest")).alias("tree"), F.sum("n").alias("n_blocks"), F.sum("bytes").alias("n_bytes"), F.bool_and("one").alias("one"), F.max("last").alias("last"), F.min("first").alias("first"))
    return roots.select("file_id", "tree", "n_blocks", "n_bytes", (F.col("one") & (F.col("first") == 0) & (F.col("last") + 1 == F.col("n_blocks"))).alias("whole"))


def verify_blocks(expected: DataFrame, blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """file_id, status of expected files (file_id, tree, file_size; both may be unknown) against the blocks that are there.

    ok; mismatch: another tree or size; incomplete: blocks are missing in between or stand twice in a place; missing: no
    block of a file that has any. No file is put together for it. Files of no length have no blocks and are ok.
    """
    got = file_digests(blocks, fan).select("file_id", F.col("tree").alias("got"), "n_bytes", "whole")
    rows = expected.select("file_id", "tree", "file_size").join(got, "file_id", "left")
    right = F.coalesce(F.col("tree") == F.col("got"), F.col("tree").isNull()) & F.coalesce(F.col("file_size") == F.col("n_bytes"), F.col("file_size").isNull())
    status = F.when(F.col("whole").isNull(), F.when(F.col("file_size") == 0, "ok").otherwise("missing")).when(~F.col("whole"), "incomplete").when(right, "ok").otherwise("mismatch")
    return rows.select("file_id", status.alias("status"))


def run_status(parts: DataFrame) -> DataFrame:
    """One row: all_ok, errors over parts (ok)."""
    return parts.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"), F.count_if(~F.col("ok")).alias("errors"))


def target_below(top: str, rel_path: str) -> str | None:
    """The place of a file below the real path of a folder; none if it is not below it, or a link leads out of it."""
    target = os.path.normpath(os.path.join(top, rel_path))
    folder = os.path.realpath(os.path.dirname(target))
    return None if target == top or os.path.commonpath([top, target]) != top or os.path.commonpath([top, folder]) != top else target


def destinations(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to write (file_id, rel_path, digest, file_size, mtime_ns), and file_id, rel_path, status of all others."""
    known = {"digest": "string", "file_size": "long", "mtime_ns": "long"}
    rows = paths.select("file_id", "rel_path", *((F.col(c) if c in paths.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items())).withColumn("rejected", X.unsafe_reason(F.col("rel_path")))
    safe = rows.where("rejected IS NULL AND rel_path IS NOT NULL").drop("rejected").withColumn("place", F.regexp_replace(F.regexp_replace("rel_path", r"(^|/)(\./)+", "$1"), "/+", "/"))
    taken = safe.groupBy("place").agg(F.min("file_id").alias("owner"))
    safe = written(safe.join(taken, "place").drop("place"))
    others = rows.where("rejected IS NOT NULL OR rel_path IS NULL").withColumn("status", F.lit("unsafe")).unionByName(safe.where("file_id <> owner").withColumn("status", F.lit("repeated")), allowMissingColumns=True)
    return safe.where("file_id = owner").drop("owner").dropDuplicates(["file_id"]), others.select("file_id", "rel_path", "status")


def _writer(root: str):
    """Files from rows sorted by file and chunk; a file appears when it is whole and right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, top = None, os.path.realpath(root)

        def begin(row: dict) -> dict:
            target = target_below(top, row["rel_path"])
            if target is None:
                return row | {"status": "unsafe", "out": None}
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            if row["chunk_index"] is None and row["digest"] is None and row["file_size"] != 0:
                return row | {"status": "missing", "out": None}
            return row | {"status": "written", "next": 0, "bytes": 0, "target": target, "part": part, "out": open(part, "wb"), "seen": hashlib.md5(usedforsecurity=False)}  # noqa: SIM115

        def end(file: dict) -> pa.RecordBatch:
            if file["out"] is not None:
                file["out"].close()
                wrong = file["file_size"] is not None and file["bytes"] != file["file_size"]
                if file["status"] == "incomplete":
                    os.remove(file["part"])
                elif wrong or file["digest"] is not None and file["seen"].hexdigest() != file["digest"]:
                    os.remove(file["part"])
                    file["status"] = "mismatch"
                else:
                    if file["mtime_ns"] is not None:
                        os.utime(file["part"], ns=(file["mtime_ns"], file["mtime_ns"]))
                    os.replace(file["part"], file["target"])
            return pa.RecordBatch.from_pylist([{"file_id": file["file_id"], "rel_path": file["rel_path"], "status": file["status"]}])

        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if held is None or row["file_id"] != held["file_id"]:
                        if held is not None:
                            yield end(held)
                        held = begin(row)
                    if held["out"] is not None and row["chunk_index"] is not None:
                        if row["chunk_index"] != held["next"] or row["data"] is None:
                            held["status"] = "incomplete"
                        row["data"] = row["data"] or b""
                        held["next"], held["bytes"] = row["chunk_index"] + 1, held["bytes"] + len(row["data"])
                        held["out"].write(row["data"])
                        held["seen"].update(row["data"])
            if held is not None:
                yield end(held)
                held = None
        finally:
            if held is not None and held["out"] is not None and os.path.exists(held["part"]):
                held["out"].close()
                os.remove(held["part"])

    return run


def materialize(blocks: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """Write blocks as files below a folder that all executors share: file_id, rel_path, status of each file.

    paths: file_id, rel_path, and where they are known digest, file_size and mtime_ns. A file is put together beside its
    place; if it is right it gets its time and appears, else it is thrown away: mismatch for another digest or size,
    incomplete for blocks that don't run on from 0, missing for a file without any of which neither size nor digest
    says that it is empty. Of several ids with one path the least is written, the others are repeated. Paths that are
    unsafe, or lead out of the folder through a link, are not written (unsafe). A file is one task's work, a block at a
    time.
    """
    if "://" in root:
        raise ValueError(f"files are written to a folder that all executors see, not to {root}")
    good, others = destinations(paths)
    data = good.join(blocks.dropDuplicates(["file_id", "chunk_index"]).select("file_id", "chunk_index", F.col("data").cast("binary").alias("data")), "file_id", "left")
    kind = paths.schema["file_id"].dataType.simpleString()
    done = data.repartition("file_id").sortWithinPartitions("file_id", "chunk_index").select("file_id", "rel_path", "digest", "file_size", "mtime_ns", "chunk_index", "data").mapInArrow(_writer(root), f"file_id {kind}, rel_path string, status string")
    return written(done.unionByName(others))
