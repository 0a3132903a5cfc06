"""Files written by several tasks each: parts at their offsets first, then each file is checked and moved to its place."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.functions.tables import written
from snapsync.operators.verify import destinations, target_below
from snapsync.sources.manifests import CONTROL_DIR

_NOTHING = hashlib.md5(b"", usedforsecurity=False).hexdigest()


def _staged(staging: str, file_id) -> str:
    name = hashlib.md5(str(file_id).encode(), usedforsecurity=False).hexdigest()
    return os.path.join(staging, name[:2], name[2:])


def _part_writer(staging: str, block_bytes: int, part_blocks: int, names: list[str]):
    """One row for each part, from its blocks in order; a task that runs again writes the same bytes again."""

    def rows(batches):
        for batch in batches:
            data = batch.column(3)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                yield *row, data[i].as_py()

    def write(file_id, part: int, blocks) -> dict:
        path = _staged(staging, file_id)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        seen, n, size, right, last = hashlib.md5(usedforsecurity=False), 0, 0, True, None
        out = os.open(path, os.O_CREAT | os.O_WRONLY)
        try:
            for _, _, index, data in blocks:
                if last is not None and index == last[0]:
                    right = right and data == last[1]
                    continue
                full_before = last is None or len(last[1] or b"") == block_bytes
                right = right and full_before and data is not None and len(data) <= block_bytes and index == part * part_blocks + n
                left, at = memoryview(data or b""), index * block_bytes
                seen.update(left)
                n, size, last = n + 1, size + len(left), (index, data)
                while left:
                    done = os.pwrite(out, left, at)
                    left, at = left[done:], at + done
        finally:
            os.close(out)
        return dict(zip(names, (file_id, part, size, right, n == part_blocks and len(last[1] or b"") == block_bytes, seen.hexdigest())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = (write(file_id, part, blocks) for (file_id, part), blocks in groupby(rows(batches), lambda x: x[:2]))
        while some := list(islice(done, 1000)):
            yield pa.RecordBatch.from_pylist(some)

    return run


def _digest(path: str) -> str:
    seen = hashlib.md5(usedforsecurity=False)
    with open(path, "rb") as f:
        while data := f.read(1 << 22):
            seen.update(data)
    return seen.hexdigest()


def _settled(root: str, staging: str):
    """Files that are right go to their places, others are removed. What an earlier try has moved is found there."""

    def settle(top: str, file: dict) -> str:
        target, staged = target_below(top, file["rel_path"]), _staged(staging, file["file_id"])
        if target is None:
            return "unsafe"
        if file["n_parts"] is None:
            if file["file_size"] != 0 and not (file["file_size"] is None and file["digest"] == _NOTHING):
                return "missing"
            os.makedirs(os.path.dirname(staged), exist_ok=True)
            open(staged, "wb").close()
        elif not file["whole"]:
            return "incomplete"
        held = staged if os.path.exists(staged) else target
        if file["file_size"] is not None and file["file_size"] != (file["n_bytes"] or 0) or not os.path.exists(held):
            return "mismatch"
        if file["digest"] is not None and file["digest"] != (file["one"] if file["n_parts"] == 1 else _digest(held)):
            return "mismatch"
        if held == staged:
            if file["mtime_ns"] is not None:
                os.utime(staged, ns=(file["mtime_ns"], file["mtime_ns"]))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(staged, target)
        return "written"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = os.path.realpath(root)
        for batch in batches:
            files = batch.to_pylist()
            statuses = [settle(top, x) for x in files]
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["rel_path"], pa.array(statuses, pa.string())], ["file_id", "rel_path", "status"])

    return run


def _removed(staging: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                shutil.rmtree(os.path.join(staging, f"{i:02x}"), ignore_errors=True)
            yield batch

    return run


def materialize_in_parts(blocks: DataFrame, paths: DataFrame, root: str, block_bytes: int, part_blocks: int = 256) -> DataFrame:
    """verify.materialize() for blocks of block_bytes each, but for a file's last: so many of them are one task's work.

    Blocks (file_id, chunk_index, data) are dealt out by file and part and written at their offsets, below the tool's own
    folder in root. A row for each part tells what came; each file is then checked by its rows and moved to its place,
    or removed. Statuses are those of materialize(); a block of another size than block_bytes before the last, or two
    different ones in one place, make a file incomplete. The digest of a file of one part is taken as it is written; of
    one with more parts it is read again by one task, some megabytes at a time, if paths has a digest. Blocks without a
    file in paths are written aside and removed. Tasks that run again do the same again; a run that is ended midway
    leaves its folder, and no half-written file in any place.
    """
    if "://" in root:
        raise ValueError(f"files are written to a folder that all executors see, not to {root}")
    spark, staging = blocks.sparkSession, os.path.join(root, CONTROL_DIR, f"parts-{uuid.uuid4().hex}")
    good, others = destinations(paths)
    kind = blocks.schema["file_id"].dataType.simpleString()
    rows = blocks.where("file_id IS NOT NULL AND chunk_index >= 0").select("file_id", F.floor(F.col("chunk_index") / part_blocks).cast("long").alias("part"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("data").cast("binary").alias("data"))
    names = ["file_id", "part", "n_bytes", "right", "full", "digest"]
    dealt = rows.repartition("file_id", "part").sortWithinPartitions("file_id", "part", "chunk_index")
    parts = written(dealt.mapInArrow(_part_writer(staging, block_bytes, part_blocks, names), f"file_id {kind}, part long, n_bytes long, right boolean, full boolean, digest string"))
    cut = F.when(~F.col("full"), F.col("part"))
    files = parts.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_bytes").alias("n_bytes"), F.min("digest").alias("one"), F.bool_and("right").alias("right"), F.max("part").alias("last"), F.min(cut).alias("cut"))
    whole = F.col("right") & (F.col("last") + 1 == F.col("n_parts")) & F.coalesce(F.col("cut") == F.col("last"), F.lit(True))
    known = good.join(files.select("file_id", "n_parts", "n_bytes", "one", whole.alias("whole")), "file_id", "left")
    # A number of partitions that stays: the rows are few bytes, what is done for each is not.
    known = known.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id")
    done = known.mapInArrow(_settled(root, staging), f"file_id {paths.schema['file_id'].dataType.simpleString()}, rel_path string, status string")
    done = written(done.unionByName(others))
    spark.range(256).mapInArrow(_removed(staging), "id long").count()
    return done
