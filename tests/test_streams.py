"""Streams over several runs: what is told once, what starts over, what a late or missing interval does."""

import datetime
import time

from pyspark.sql import functions as F

from snapsync.streaming import streams

UTC = datetime.timezone.utc


def _add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


ARRIVALS = "file_id long, chunk_index long, needed long"


def test_each_file_is_told_once_over_restarts(spark, tmp_path):
    """Repeats, several pages of chunks, an unknown number of chunks, and chunks after a file is told of."""
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    run = lambda: sorted((r.file_id, r.n_chunks) for r in streams.run_to_table(streams.completion(streams.read_stream(spark, path)), path=out, checkpoint=checkpoint, idle_batches=False).collect())
    _add(spark, [(1, 0, 2), (1, 0, 2), (2, 0, 1), (3, 0, None), (4, None, 1), (5, 0, 0)] + [(6, i, 9002) for i in range(9000)], ARRIVALS, path)
    assert run() == [(2, 1), (5, 1)]
    _add(spark, [(1, 0, 2), (2, 0, 1), (2, 1, 1), (6, 8999, 9002), (6, 9000, 9002)], ARRIVALS, path)
    assert run() == [(2, 1), (5, 1)]
    _add(spark, [(1, 1, 2), (6, 4097, 9002), (6, 20000, 9002)], ARRIVALS, path)
    assert run() == [(1, 2), (2, 1), (5, 1), (6, 9002)]
    _add(spark, [(1, 1, 2), (6, 1, 9002), (6, 20001, 9002)], ARRIVALS, path)
    assert run() == [(1, 2), (2, 1), (5, 1), (6, 9002)]


def test_callback_hears_of_each_file_once_over_restarts(spark, tmp_path):
    path, heard = str(tmp_path / "in"), []
    for chunk in range(3):
        _add(spark, [(f, chunk, 1 + f) for f in range(3)], ARRIVALS, path)
        streams.on_file_done(streams.read_stream(spark, path), lambda batch: heard.append(sorted(r.file_id for r in batch.collect())), str(tmp_path / "c")).awaitTermination()
    assert [x for x in heard if x] == [[0], [1], [2]]


def test_a_token_names_the_work(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "runs")
    _add(spark, [(1,), (2,)], "n long", path)
    run = lambda token: sorted(r.n for r in streams.resumed(streams.read_stream(spark, path).select("n"), folder, token).collect())
    assert run("a") == [1, 2] and run("a") == [1, 2]
    _add(spark, [(3,)], "n long", path)
    assert run("a") == [1, 2, 3] and run("b") == [1, 2, 3] and run("a") == [1, 2, 3]


def test_rates_decay_over_gaps_and_start_over_from_zero(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute, 30)
    schema = "session_id long, ts timestamp, value double"
    run = lambda: {(r.session_id, r.m): round(r.rate, 9) for r in streams.run_to_table(streams.smoothed(streams.read_stream(spark, path), 60, delay="1 minute"), path=out, checkpoint=checkpoint).withColumn("m", F.minute("start")).collect()}
    # Session 1: 0, then 100 a second; a gap of two minutes; session 2: one interval.
    _add(spark, [(1, at(0), 0.0), (1, at(1), 3000.0), (1, at(1), 3000.0), (2, at(1), 60.0), (1, at(4), 6000.0), (3, at(6), 1.0)], schema, path)
    first = run()
    assert first == {(1, 0): 0.0, (1, 1): 100.0, (2, 1): 1.0, (1, 4): round(100 * 0.81 * 0.9 + 10, 9)}
    # A row later than the watermark is left out; the next interval goes on from what the state holds.
    _add(spark, [(1, at(3), 9e9), (1, at(5), 0.0), (9, at(20), 1.0)], schema, path)
    assert run() == first | {(1, 5): round(0.9 * first[1, 4], 9), (3, 6): round(1 / 60, 9)}


def test_many_files_share_an_entry_of_state(spark, tmp_path):
    """State is read and written by buckets of files: two buckets, however many files; ids of other kinds and null ones."""
    for kind, name in (("bigint", lambda i: (1 << 53) + 1 + i), ("string", lambda i: f"f{i}")):
        path, out, checkpoint = (str(tmp_path / kind / x) for x in ("in", "out", "c"))
        schema = f"file_id {kind}, chunk_index long, needed long"
        run = lambda: sorted(((r.file_id, r.n_chunks) for r in streams.run_to_table(streams.completion(streams.read_stream(spark, path), buckets=2), path=out, checkpoint=checkpoint, idle_batches=False).collect()), key=str)  # noqa: B023, E731
        _add(spark, [(name(i), 0, 1 + i % 2) for i in range(100)] + [(None, 5000, 2), (None, -1, None)], schema, path)
        first = [(name(i), 1) for i in range(0, 100, 2)] + [(None, 2)]
        assert run() == sorted(first, key=str)
        held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
        assert held.count() == 3
        _add(spark, [(name(i), c, 2) for i in range(100) for c in (0, 1)] + [(None, 0, 1)], schema, path)
        assert run() == sorted([*first, *((name(i), 2) for i in range(1, 100, 2))], key=str)


def test_what_is_not_heard_of_is_forgotten(spark, tmp_path):
    """Counts, further pages and told files go after the time; a file that starts over counts from nothing."""
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    run = lambda: sorted((r.file_id, r.n_chunks) for r in streams.run_to_table(streams.completion(streams.read_stream(spark, path), "1 second", buckets=1), path=out, checkpoint=checkpoint, idle_batches=False).collect())
    _add(spark, [(1, 0, 3), (1, 9000, 3), (2, 0, 1)], ARRIVALS, path)
    assert run() == [(2, 1)]
    time.sleep(1.5)
    _add(spark, [(1, 1, 3), (1, 9001, 3), (2, 0, 1)], ARRIVALS, path)
    assert run() == [(2, 1), (2, 1)]
