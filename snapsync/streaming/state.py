"""What streams remember of a key, for transformWithState; state is kept by Spark in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bits of a page of a bitmap, a power of two.
PAGE = 4096


@contextmanager
def rocksdb(spark: SparkSession, idle_batches: bool = True):
    """Queries that are started inside keep their state in RocksDB.

    idle_batches: whether batches without rows run. What the watermark closes needs them; with state that goes by the
    clock there would be another one for ever, so a query over what is there now would not end.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Completion(StatefulProcessor):
    """Tells once of each key whose needed number of different chunks is in.

    Keys go by buckets of their hash, and what is held of a bucket's keys is one value: a batch costs a read and a write
    for each bucket that it touches, not for each key. The chunks seen of a key are a bitmap in pages: the first stands
    with the count, others are entries of their own, and only those that a batch touches are read. When a key is told of,
    its pages go and the time of its last row stays, so that repeats say nothing. A key that no row has come for in ttl_ms
    is forgotten with the next rows of its bucket, a bucket without rows for so long as a whole.

    Rows are bucket, key, page, bit (-1: no chunk), needed (-1: unknown), none of them null; all keys of the bucket
    NO_KEY are null.
    """

    NO_KEY = -1

    def __init__(self, key: str, kind: str, ttl_ms: int):
        self.key, self.kind, self.ttl_ms = key, kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = f"told array<{self.kind}>, told_at array<long>, open array<{self.kind}>, n array<long>, first array<binary>, pages array<array<long>>, open_at array<long>"
        self.held = handle.getValueState("held", held, self.ttl_ms)
        self.pages = handle.getMapState("pages", f"key {self.kind}, page long", "bits binary")

    @staticmethod
    def _marked(bits: bytes | None, places: int) -> tuple[bytes, int]:
        """A page with the bits of places set, and how many were new."""
        before = int.from_bytes(bits or b"", "little")
        after = before | places
        return after.to_bytes((after.bit_length() + 7) // 8, "little"), after.bit_count() - before.bit_count()

    def _read(self, now: int) -> tuple[dict, dict]:
        """Times of the keys told of; count, first page, further pages and time of the open ones, without what is forgotten."""
        held = self.held.get()
        if held is None:
            self.pages.clear()
            return {}, {}
        told = {k: at for k, at in zip(held[0], held[1]) if at + self.ttl_ms > now}
        known = {k: x for k, *x in zip(*held[2:])}
        for k in [k for k, x in known.items() if x[3] + self.ttl_ms <= now]:
            self._drop(k, known.pop(k)[2])
        return told, known

    def _drop(self, key, pages) -> None:
        for page in pages:
            self.pages.removeKey((key, page))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, without = timerValues.getCurrentProcessingTimeInMs(), key[0] == self.NO_KEY
        told, known = self._read(now)
        seen, needed = {}, {}
        for part in rows:
            for k, page, bit, wanted in zip(*(part.iloc[:, i].tolist() for i in range(1, 5))):
                k = None if without else k
                if k in told:
                    told[k] = now
                    continue
                places = seen.setdefault(k, {})
                if bit >= 0:
                    places[page] = places.get(page, 0) | 1 << bit
                if wanted > needed.get(k, -1):
                    needed[k] = wanted
        done, counts = [], []
        for k, places in seen.items():
            n, first, pages, _ = known.pop(k, (0, None, [], None))
            for page, bits in places.items():
                if page == 0:
                    first, new = self._marked(first, bits)
                else:
                    after, new = self._marked((self.pages.getValue((k, page)) or (None,))[0], bits)
                    self.pages.updateValue((k, page), (after,))
                n += new
            pages = [*pages, *(places.keys() - {0, *pages})]
            if n >= needed.get(k, n + 1):
                self._drop(k, pages)
                told[k] = now
                done.append(k)
                counts.append(n)
            else:
                known[k] = (n, first, pages, now)
        columns = list(zip(*known.values())) or [[]] * 4
        self.held.update((list(told), list(told.values()), list(known), *map(list, columns)))
        if done:
            yield pd.DataFrame({self.key: pd.Series(done, dtype=object if without else None), "n_chunks": counts})

    def close(self) -> None:
        pass


class Smoothing(StatefulProcessor):
    """The smoothed rate of a key after each of its intervals, which come in order from batch to batch.

    A rate of 0 starts over with the next one. Intervals without rows between two others have the rate 0.
    """

    def __init__(self, key: str, seconds: float, keep: float):
        self.key, self.seconds, self.keep = key, seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "rate double, start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = pd.concat(list(rows)).sort_values("start")
        rate, before = self.last.get() or (0.0, None)
        rates, step = [], round(self.seconds * 1e6)
        for start, value in zip(sums["start"].astype("datetime64[us]").astype("int64"), (sums["bytes"] / self.seconds).astype(float)):
            if before is not None:
                rate *= self.keep ** ((start - before) // step - 1)
            rate = value if rate == 0 else self.keep * rate + (1 - self.keep) * value
            before = start
            rates.append(rate)
        self.last.update((float(rate), int(before)))
        yield pd.DataFrame({self.key: key[0], "start": sums["start"].to_numpy(), "rate": rates})

    def close(self) -> None:
        pass
