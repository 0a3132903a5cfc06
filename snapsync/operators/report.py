"""Summaries of a session, and smoothed rates."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType

from snapsync.functions.tables import folded

LEAST_SECONDS, KEEP = 0.05, 0.9


def session_summary(plan: DataFrame) -> DataFrame:
    """One row over files with skipped (boolean) and file_size."""
    skipped = F.coalesce(F.sum(F.when(F.col("skipped"), F.col("file_size"))), F.lit(0)).cast("long")
    total = F.coalesce(F.sum("file_size"), F.lit(0)).cast("long")
    row = plan.agg(F.count(F.lit(1)).alias("files_total"), F.count_if("skipped").alias("files_skipped"), total.alias("bytes_total"), skipped.alias("bytes_skipped"))
    row = row.withColumn("files_sent", F.col("files_total") - F.col("files_skipped")).withColumn("bytes_sent", F.col("bytes_total") - F.col("bytes_skipped"))
    return row.withColumn("up_to_date", (F.col("bytes_sent") == 0) & (F.col("files_total") > 0))


class _Smoothed:
    """The smoothed rate after samples in order of time; a sample too close to the last used one is passed over.

    Unknown counters are NaN inside.
    """

    def __init__(self):
        self.t, self.c, self.rate, self.n = None, math.nan, 0.0, 0

    def _next(self, ts: list[float], low: int) -> int:
        """The place of the next sample to use, from low on."""
        if self.t is None:
            return low
        i = bisect_left(ts, self.t + LEAST_SECONDS, low)
        while i > low and ts[i - 1] - self.t >= LEAST_SECONDS:
            i -= 1
        while i < len(ts) and ts[i] - self.t < LEAST_SECONDS:
            i += 1
        return i

    def _use(self, t: float, c: float) -> None:
        if self.t is not None:
            inst = (c - self.c) / (t - self.t)
            self.rate = inst if self.c == 0 or self.rate == 0 else KEEP * self.rate + 0.1 * inst
            self.n += 1
        self.t, self.c = t, c

    def walk(self, ts: list[float], cs: list[float]) -> None:
        i = self._next(ts, 0)
        while i < len(ts):
            self._use(ts[i], cs[i])
            i = self._next(ts, i + 1)

    def add(self, first, ts, cs, *jumps) -> None:
        """A block: its samples themselves, or those at which it may be entered, with what the rest makes of a rate."""
        if jumps[0] is None:
            return self.walk(ts, cs)
        i = self._next(ts, 0)
        if i < len(ts):
            self._use(ts[i], cs[i])
            self.t, self.c, n, fixed, factor, plus, from_zero = (x[i] for x in jumps)
            self.rate = from_zero if self.rate == 0 else plus if fixed else factor * self.rate + plus
            self.n += n

    def result(self):
        return None if math.isnan(self.rate) else self.rate, self.n


def _jumps(t: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For each sample at which a block may be entered: t, c, the last sample used then (t, c), the steps to it, and
    what they make of a rate r: plus where fixed, else factor * r + plus; from_zero of a rate of 0, which starts over.

    Steps are affine maps; they are composed by doubling, all samples at once.
    """
    n, own = len(t), np.arange(len(t))
    to = np.searchsorted(t, t + LEAST_SECONDS)
    to = np.where(t[to - 1] - t >= LEAST_SECONDS, to - 1, to)  # sums are rounded, the rule goes by differences
    to = np.where((to < n) & (t[np.minimum(to, n - 1)] - t < LEAST_SECONDS), to + 1, to)
    entries, inside = min(n, int(to[0]) + 1), to < n
    to = np.where(inside, to, own)
    inst = np.where(inside, (c[to] - c) / np.where(inside, t[to] - t, 1.0), 0.0)
    fixed = inside & (c == 0)
    factor = np.where(inside, np.where(fixed, 0.0, KEEP), 1.0)
    plus, from_zero, steps = np.where(fixed, inst, 0.1 * inst), inst, inside.astype(np.int64)
    while (to[to] != to).any():
        then = lambda x: np.where(x == 0, from_zero[to], np.where(fixed[to], plus[to], factor[to] * x + plus[to]))  # noqa: E731, B023
        plus, from_zero = np.where(fixed, then(plus), np.where(fixed[to], plus[to], factor[to] * plus + plus[to])), then(from_zero)
        fixed, factor = fixed | fixed[to], factor * factor[to]
        steps, to = steps + steps[to], to[to]
    return [x[:entries] for x in (t, c, t[to], c[to], steps, fixed, factor, plus, from_zero)]


#: Samples of a block that is sent as a map, and up to which number they are sent themselves.
BLOCK, FEW = 1 << 16, 1 << 12
_JUMPS = "last_t array<double>, last_c array<double>, steps array<bigint>, fixed array<boolean>, factor array<double>, plus array<double>, from_zero array<double>"


def _blocks(key_type: pa.DataType, block: int, few: int):
    """key, first and the arrays of blocks, from rows (key, t, c) sorted by key and t.

    The task's first key may go on from the task before, so its blocks stand open at their start; every other key begins
    here, and what comes of its rows is known.
    """
    lists = [pa.list_(x) for x in (*(pa.float64(),) * 4, pa.int64(), pa.bool_(), *(pa.float64(),) * 3)]

    def row(key, first: float | None, arrays: list) -> pa.RecordBatch:
        columns = [pa.array([key], key_type), pa.array([first], pa.float64()), *(pa.array([a], k) for a, k in zip([*arrays, *[None] * (len(lists) - len(arrays))], lists))]
        return pa.RecordBatch.from_arrays(columns, ["key", "first", "ts", "cs", *(x.split()[0] for x in _JUMPS.split(", "))])

    def runs(batches):
        for batch in batches:
            start, parts = 0, pc.run_end_encode(batch.column(0))
            for key, end in zip(parts.values.to_pylist(), parts.run_ends.to_pylist()):
                t, c = (batch.column(i).slice(start, end - start).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (1, 2))
                timed = ~np.isnan(t)
                yield key, t[timed], c[timed]
                start = end

    def open_key(key, pieces):
        t = c = np.zeros(0)
        for _, more_t, more_c in pieces:
            t, c = np.concatenate([t, more_t]), np.concatenate([c, more_c])
            while len(t) >= block:
                yield row(key, t[0], _jumps(t[:block], c[:block]))
                t, c = t[block:], c[block:]
        yield row(key, t[0] if len(t) else None, [t, c] if len(t) <= few else _jumps(t, c))

    def begun_key(key, pieces):
        state, first, c0 = _Smoothed(), None, None
        for _, t, c in pieces:
            if first is None and len(t):
                first, c0 = float(t[0]), float(c[0])
            state.walk(t.tolist(), c.tolist())
        if first is None:
            yield row(key, None, [[], []])
        else:
            yield row(key, first, [[first], [c0], [state.t], [state.c], [state.n], [True], [0.0], [state.rate], [state.rate]])

    def run(batches):
        with np.errstate(all="ignore"):
            for i, (key, pieces) in enumerate(groupby(runs(batches), lambda x: x[0])):
                yield from (begun_key if i else open_key)(key, pieces)

    return run


def ewma_rate(samples: DataFrame, key: str, ts: str, counter: str, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """key, rate, n_used: the smoothed rate of a counter by key.

    Samples closer than LEAST_SECONDS to the last used one wait; the first rate is taken as it is, and so is one after a
    counter or a rate of 0. Of samples at one time the one with the least counter counts. A null counter makes the rate
    null until it starts over; rows without a time change nothing, and a key with no others has the rate 0.

    Rows are dealt out by ranges of key and time, so a key with many rows is worked on by many tasks. A block of them
    becomes one row: the samples at which it may be entered (those of its first LEAST_SECONDS), and for each the affine
    map that it applies to a rate. A key's blocks are then taken in order; its other rows never meet in one task.
    Rates of keys that are cut so differ from those of one pass by rounding alone, as long as no falling counter brings
    a rate to precisely 0 within a block.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = samples.select(F.col(key).alias("key"), seconds.alias("t"), F.col(counter).cast("double").alias("c")).groupBy("key", "t").agg(F.min("c").alias("c"))
    kind = samples.schema[key].dataType
    ranged = rows.repartitionByRange("key", "t").sortWithinPartitions("key", "t")
    blocks = ranged.mapInArrow(_blocks(to_arrow_type(kind), block, few), f"key {kind.simpleString()}, first double, ts array<double>, cs array<double>, {_JUMPS}")
    values = ["first", "ts", "cs", *(x.split()[0] for x in _JUMPS.split(", "))]
    return folded(blocks, "key", values, _Smoothed, [("rate", DoubleType()), ("n_used", IntegerType())]).withColumnRenamed("key", key)


def eta(rows: DataFrame) -> DataFrame:
    """rows (done, total, rate) with percent (0 to 100; 0 of nothing) and eta_s (null if unknown)."""
    left = F.col("total") - F.col("done")
    share = F.when(F.col("total") > 0, 100.0 * F.col("done") / F.nullif("total", F.lit(0))).otherwise(0.0)
    return rows.withColumn("percent", F.least(F.lit(100.0), F.greatest(F.lit(0.0), share))).withColumn("eta_s", F.when((F.col("rate") > 0) & (left > 0), F.floor(left / F.col("rate"))))


def group_parts(parts: DataFrame, timeout_s: int) -> DataFrame:
    """session_id, expected, age_s, status of each group of parts (session_id, expected, ts, event_id).

    complete: as many as expected within the timeout after the first; else expired.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("session_id")
    rows = parts.withColumn("n", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("first", F.min("ts").over(w))
    at = rows.where(F.col("n") == F.col("expected")).select("session_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6).alias("age_s"))
    groups = parts.groupBy("session_id").agg(F.max("expected").alias("expected"))
    return groups.join(at, "session_id", "left").withColumn("status", F.when(F.col("age_s") <= timeout_s, "complete").otherwise("expired"))


def idle_gc(sessions: DataFrame, now, idle_s: int = 300) -> DataFrame:
    """Sessions (last_seen, done) that are neither done nor older than so many seconds."""
    return sessions.where(~F.col("done") & (F.unix_micros(F.col("last_seen").cast("timestamp")) >= F.unix_micros(now) - idle_s * 1_000_000))
