"""Small files that a driver reads and writes beside its tables, in whatever store holds them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Path:
    """A file or folder of a store that Hadoop opens."""

    def __init__(self, spark: SparkSession, address: str):
        self.spark, self.address = spark, address.rstrip("/")
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(self.address)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str) -> Path:
        return Path(self.spark, f"{self.address}/{name}")

    def names(self) -> list[str]:
        """The files directly in a folder, in order, without hidden ones; none where there is no folder."""
        if not self.store.exists(self.path):
            return []
        return sorted(x.getPath().getName() for x in self.store.listStatus(self.path) if x.isFile() and x.getPath().getName()[0] not in "._")

    def read(self) -> str:
        stream = self.store.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str) -> None:
        """A new file; one that is there already is an error."""
        stream = self.store.create(self.path, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def local(self) -> str | None:
        """The path as the system's own, if this is a local or mounted folder."""
        return self.store.makeQualified(self.path).toUri().getPath() if self.store.getScheme() == "file" else None

    def move_if_free(self, target: Path) -> bool:
        """Put this file in the target's place if nothing is there, in one step; it is gone from its own either way."""
        here, there = self.local(), target.local()
        try:
            if here is None:
                return not self.store.exists(target.path) and self.store.rename(self.path, target.path)
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            self.store.delete(self.path, False)
