"""Shared helpers of the text operators: table access, durable cuts of lineage, vectorised hashing of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and U+0009..U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; a session on one machine (tests) may go without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until df has no such column (in any case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Array of words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of arbitrary ranges, from one prefix sum; the odd base is invertible."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The prefix sum of values that between() reads."""
        self._grow(len(values) + 1)
        prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=prefix[1:])
        return prefix

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.inverses[starts]

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.between(self.sums(values), starts, ends)


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IN_WORD, _IN_WINDOW = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)


class Words:
    """Words of a slice of an Arrow string column: byte ranges, 64-bit hashes and the row of each, as flat arrays.

    Rows that are null or blank have no words. No Python object is made for a word.
    """

    def __init__(self, column: pa.Array):
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            column = column.cast(pa.large_binary())
        elif pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        data = column.buffers()[2] if n else None
        self.bytes = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        self.rows = n
        solid = ~_SPACE[self.bytes]
        first = np.zeros(len(self.bytes) + 1, dtype=bool)
        first[self.offsets] = True
        before = np.concatenate([np.zeros(1, bool), solid[:-1]]) if len(solid) else solid
        after = np.concatenate([solid[1:], np.zeros(1, bool)]) if len(solid) else solid
        self.starts = np.flatnonzero(solid & (~before | first[:-1]))
        self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.row, minlength=n) if n else np.zeros(0, np.int64)
        self.first_word = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mix64(_IN_WORD.ranges(_BYTES[self.bytes], self.starts, self.ends) + lengths * np.uint64(0xA0761D6478BD642F))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of so many words inside one row."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - size + 1)
        at = at[self.row[: n - size + 1] == self.row[size - 1 :]]
        return at, mix64(_IN_WINDOW.ranges(hashes, at, at + size) + np.uint64(size))


def slices(column: pa.Array, most_bytes: int = 1 << 20):
    """(from, to) of row ranges of at most so many bytes; a longer single text is a range of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most_bytes:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def by_group(batches, keys: list[str]):
    """(key, table) of each run of rows with equal keys in batches sorted by them; a run may go on in the next batch."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


#: Spark's setting by which a query's shuffle files go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again.

    Later reads see the same rows whatever executors are lost, so what was shuffled for them is removed at once. The
    files stay until that folder is cleared.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


class KeyTable:
    """Places of 64-bit keys, found in bulk: open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(2, 16 * len(keys))))))
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for place, key in enumerate(keys.tolist()):
            slot = key >> (64 - self.bits)
            while self.places[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.places[slot] = key, place

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for unknown ones."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.places[slot], -1)
        open_ = np.flatnonzero((out == -1) & (self.places[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            hit = (self.keys[at] == keys[open_]) & (self.places[at] != -1)
            out[open_[hit]] = self.places[at[hit]]
            open_ = open_[~hit & (self.places[at] != -1)]
        return out
