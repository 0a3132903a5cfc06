"""Decisions, completion, checks and rates over streams of manifests and chunk arrivals.

Each function takes a streaming DataFrame and gives one, or starts a query; results of a finished stream equal those
of the batch operator of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from snapsync.functions.tables import shared_folder, written
from snapsync.plans import decisions as D
from snapsync.streaming.state import PAGE, Completion, Smoothing, rocksdb


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files; its schema is read from the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream reads folders; of a table that is one file, it reads the folder with that name alone.
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None, idle_batches: bool = True) -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder.

    With the same path and checkpoint, a later run goes on where this one ended. A table that is kept in update mode
    holds every update; the last one of a key has the largest batch_id. idle_batches: see state.rocksdb().
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"
    schema = stream.schema

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb(spark, idle_batches):
        query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema.add("batch_id", "long")).option("recursiveFileLookup", "true").parquet(path)
    return rows if mode == "update" else rows.drop("batch_id")


def resumed(stream: DataFrame, folder: str, token: str, mode: str = "append") -> DataFrame:
    """run_to_table() with table and checkpoint in folder under the token of what is worked on.

    A later run with the same token goes on where the last one ended, and gives the table of all runs. Under another
    token the work starts over, beside what the former one left.
    """
    return run_to_table(stream, mode, f"{folder}/{token}/table", f"{folder}/{token}/checkpoint")


def wants(manifests: DataFrame, target: DataFrame) -> DataFrame:
    """Decide for each manifest row while rows still come; target is a table."""
    return D.want_files(manifests, target)


def completion(arrivals: DataFrame, remember: str = "7 days", buckets: int = 1 << 14) -> DataFrame:
    """file_id, n_chunks of each file, once, when its needed number of different chunks is in (append mode).

    arrivals: file_id, chunk_index (from 0), needed. State is a bitmap of a file's chunks until it is complete, then a
    flag; what is remembered of a file goes when nothing has arrived for it for so long (it would start over then).
    Files go by so many buckets, which one value of state holds each; a checkpoint keeps the number it began with.
    Run it without idle batches.
    """
    kind = arrivals.schema["file_id"].dataType
    # Numbers with nulls among them would come as floats: null ids have a bucket of their own, and any number.
    file_id = F.coalesce("file_id", F.lit(0).cast(kind)) if isinstance(kind, IntegralType) else F.col("file_id")
    bucket = F.when(F.col("file_id").isNull(), Completion.NO_KEY).otherwise(F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
    chunk, needed = F.col("chunk_index").cast("long"), F.col("needed").cast("long")
    page = F.coalesce(F.shiftright(chunk, PAGE.bit_length() - 1), F.lit(0).cast("long"))
    bit = F.coalesce(chunk.bitwiseAND(F.lit(PAGE - 1)).cast("int"), F.lit(-1))
    wanted = F.when(needed.isNull(), F.lit(-1).cast("long")).otherwise(F.greatest(needed, F.lit(0).cast("long")))
    rows = arrivals.select(bucket.alias("bucket"), file_id.alias("file_id"), page.alias("page"), bit.alias("bit"), wanted.alias("needed"))
    ttl = int(pd.Timedelta(remember).total_seconds() * 1000)
    return rows.groupBy("bucket").transformWithStateInPandas(Completion("file_id", kind.simpleString(), ttl), f"file_id {kind.simpleString()}, n_chunks long", "append", "processingTime")


def dedupe(arrivals: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Arrivals with repeated (file_id, chunk_index) dropped, within the watermark's delay."""
    timed = arrivals.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(["file_id", "chunk_index"])


def verified(blocks: DataFrame) -> DataFrame:
    """blocks (data, digest) with ok; a sink splits good ones from those to send again."""
    return blocks.withColumn("ok", F.md5("data") == F.col("digest"))


def split_verified(blocks: DataFrame, done: str, retry: str, checkpoint: str) -> None:
    """Blocks (data, digest) of a stream, as they are now, into two tables: good ones to done, the others to retry."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = written(verified(batch))
        for path, which in ((done, F.col("ok")), (retry, ~F.coalesce("ok", F.lit(False)))):
            rows.where(which).drop("ok").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    blocks.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def throughput(counters: DataFrame, interval: str, delay: str = "1 day") -> DataFrame:
    """session_id, start, bytes: sums of value in each interval of ts."""
    timed = counters.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("session_id", F.window("ts", interval).alias("w")).agg(F.sum("value").alias("bytes")).select("session_id", F.col("w.start").alias("start"), "bytes")


def group_parts(parts: DataFrame, timeout_s: int, delay: str = "3650 days") -> DataFrame:
    """session_id, first_ts, n of each group of parts so far; update mode gives a row for each change."""
    timed = parts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))


def smoothed(counters: DataFrame, seconds: int, keep: float = 0.9, delay: str = "1 day") -> DataFrame:
    """session_id, start, rate after each interval of so many seconds that the watermark has closed, in one live query.

    counters: session_id, ts, value. An interval's sum is closed when the watermark (delay behind the latest ts) has
    passed it; then it goes into the session's smoothed rate, by report.ewma_rate's rule: a rate of 0 starts over with
    the next one, others weigh keep. Intervals without rows count as 0. Rows later than the watermark are left out.
    """
    sums = throughput(counters, f"{seconds} seconds", delay)
    kind = sums.schema["session_id"].dataType.simpleString()
    return sums.groupBy("session_id").transformWithStateInPandas(Smoothing("session_id", float(seconds), keep), f"session_id {kind}, start timestamp, rate double", "append", "none")


def timed_groups(parts: DataFrame, timeout_s: int, delay: str) -> DataFrame:
    """session_id, expected, status of each group of parts (session_id, expected, ts), once.

    complete: as many as expected are in within the timeout after the first; expired: the timeout is over, as a later
    part or the watermark tells. A group is forgotten when its timeout is over.
    """
    timed = parts.select("session_id", F.col("expected").cast("long").alias("expected"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    micros = timeout_s * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, n, expected, told = state.get if state.exists else (None, 0, 0, False)
        status = None
        if state.hasTimedOut:
            status = None if told else "expired"
            state.remove()
        else:
            rows = pd.concat(list(batches))
            expected = int(rows["expected"].max())
            for at in sorted(rows["ts"].astype("datetime64[us]").astype("int64")):
                first, n = at if first is None else first, n + 1
                if not told and status is None and (n == expected or at - first > micros):
                    status = "complete" if at - first <= micros else "expired"
            state.update((first, n, expected, told or status is not None))
            state.setTimeoutTimestamp(max(first // 1000 + timeout_s * 1000, state.getCurrentWatermarkMs()) + 1)
        if status is not None:
            yield pd.DataFrame({"session_id": [key[0]], "expected": [expected], "status": [status]})

    kind = parts.schema["session_id"].dataType.simpleString()
    return timed.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, expected long, status string", "first long, n long, expected long, told boolean", "append", "EventTimeTimeout")


def idle_sessions(events: DataFrame, idle_s: int, delay: str) -> DataFrame:
    """session_id, first_seen, last_seen of each stay of a session, when it has been idle for so many seconds."""
    timed = events.select("session_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    stays = timed.groupBy("session_id", F.session_window("ts", f"{idle_s} seconds").alias("stay")).agg(F.max("ts").alias("last_seen"))
    return stays.select("session_id", F.col("stay.start").alias("first_seen"), "last_seen")


def on_file_done(arrivals: DataFrame, callback: Callable[[DataFrame], None], checkpoint: str, remember: str = "7 days"):
    """Start a query that hands each batch of newly complete files to callback, each file once.

    What was told stands in the query's own state, a flag a file, so a batch costs what it holds. A batch that is run
    again after a failure hands over the same rows again.
    """
    with rocksdb(arrivals.sparkSession, idle_batches=False):
        return completion(arrivals, remember).writeStream.foreachBatch(lambda batch, _: callback(batch)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
