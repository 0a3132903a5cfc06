"""Many small files in one record. Packing depends on the order within a lane; lanes are independent.

A lane is cut in blocks of files, so that no task holds more than one of them. Within a block, for each file that may
be the first start of a bundle there (one of the first most_files), the first start in the next block follows from the
sizes alone; joins with doubling steps over those tables then give the true first start of every block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.functions.tables import running, written

MOST_BYTES, MOST_FILES = 32 << 20, 65536
#: Files of a lane that one task looks at together, beside the few that a last bundle may take from the next block.
BLOCK_FILES = 1 << 16


def _next_starts(sizes: np.ndarray, close_after: bool, most_bytes: int, most_files: int) -> np.ndarray:
    """For each file, the place where the next bundle starts if one starts here."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if close_after:
        to = np.searchsorted(sums, sums[:-1] + most_bytes, side="left")
    else:
        to = np.searchsorted(sums, sums[:-1] + most_bytes, side="right") - 1
    here = np.arange(len(sizes))
    return np.minimum(np.maximum(to, here + 1), here + most_files)


def _jumps(block_files: int, *limits):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        to = _next_starts(group["file_size"].to_numpy(np.int64), *limits).tolist()
        own = min(block_files, len(to))
        leave, n = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            j = to[i]
            leave[i], n[i] = (j, 1) if j >= own else (leave[j], n[j] + 1)
        entries = min(own, limits[-1])
        return pd.DataFrame({"lane": key[0], "block": key[1], "entry": range(entries), "leave": [x - block_files for x in leave[:entries]], "n": n[:entries]})

    return run


def _packed(*limits):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        to = _next_starts(group["file_size"].to_numpy(np.int64), *limits).tolist()
        starts, at = np.zeros(len(to), np.int64), int(group["entry"].iloc[0])
        while at < len(to):
            starts[at], at = 1, to[at]
        return group.assign(bundle_id=group["before"] - 1 + np.cumsum(starts))[["lane", "bundle_id", "file_id", "file_size", "place"]]

    return run


def _entries(jumps: DataFrame, blocks: int) -> DataFrame:
    """lane, block, entry, before: the first start in each block, and the bundles that start before the block."""
    found = jumps.where("block = 0 AND entry = 0").select("lane", "block", "entry", F.lit(0).cast("long").alias("before"))
    step, reach = jumps, 1
    while reach < blocks:
        on = lambda rows: rows.join(step.select("lane", "block", "entry", "leave", "n"), ["lane", "block", "entry"])  # noqa: B023, E731
        more = on(found).select("lane", (F.col("block") + reach).alias("block"), F.col("leave").alias("entry"), (F.col("before") + F.col("n")).alias("before"))
        found = written(found.unionByName(more))
        if 2 * reach < blocks:
            far = step.select("lane", (F.col("block") - reach).alias("block"), F.col("entry").alias("leave"), F.col("leave").alias("far"), F.col("n").alias("m"))
            step = written(step.join(far, ["lane", "block", "leave"]).select("lane", "block", "entry", F.col("far").alias("leave"), (F.col("n") + F.col("m")).alias("n")))
        reach *= 2
    return found


def pack(files: DataFrame, close_after: bool, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """lane, bundle_id, file_id, file_size, place. close_after: a bundle takes the file that fills it; else a file that
    would overfill starts the next, and one too large for any has its own."""
    limits, size = (close_after, most_bytes, most_files), max(BLOCK_FILES, most_files)
    rows = files.select(F.struct("lane", "place").alias("__key"), F.lit(1).alias("__one"), "lane", "file_id", "file_size", "place")
    rows = written(running(rows, "__key", "__one", "__before", "__nth").drop("__key", "__one", "__before"))
    first = rows.groupBy("lane").agg(F.min("__nth").alias("__first"), F.count(F.lit(1)).alias("__n"))
    nth = F.col("__nth") - F.col("__first")
    rows = rows.join(F.broadcast(first.drop("__n")), "lane").select("lane", F.floor(nth / size).alias("block"), (nth % size).alias("at"), "file_id", "file_size", "place")
    ahead = rows.where((F.col("at") < most_files) & (F.col("block") > 0)).select("lane", (F.col("block") - 1).alias("block"), (F.col("at") + size).alias("at"), "file_size")
    seen = rows.select("lane", "block", "at", "file_size").unionByName(ahead)
    jumps = written(seen.groupBy("lane", "block").applyInPandas(_jumps(size, *limits), "lane int, block long, entry long, leave long, n long"))
    blocks = (first.agg(F.max("__n")).first()[0] or 0) // size + 1
    rows = rows.join(_entries(jumps, blocks), ["lane", "block"])
    return rows.groupBy("lane", "block").applyInPandas(_packed(*limits), "lane int, bundle_id long, file_id long, file_size long, place long")


def write_bundles(packed: DataFrame, contents: DataFrame) -> DataFrame:
    """lane, bundle_id, file_count, total_size, entries of file_id, digest, content; contents: file_id, text."""
    rows = packed.join(contents.select("file_id", "text"), "file_id")
    entry = F.struct("place", "file_id", F.md5("text").alias("digest"), F.col("text").cast("binary").alias("content"))
    return rows.groupBy("lane", "bundle_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("file_size").alias("total_size"), F.array_sort(F.collect_list(entry)).alias("entries"))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """file_id, content, ok of each entry: its digest is right."""
    rows = bundles.select(F.inline("entries"))
    return rows.select("file_id", "content", (F.md5("content") == F.col("digest")).alias("ok"))
