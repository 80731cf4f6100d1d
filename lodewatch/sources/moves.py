"""A log of migrations between tiers: what a run reads, what it has staged, and how far it came.

root/_moves/<run>/ has `reads` (the files that the run takes rows from), `staged/<tier>/...` (the files it writes, in the tiers' layout),
and a marker for each state that it has reached. A run is planned, staged, checked and then committed; what isn't committed never
happened, and what is committed is finished by whoever comes next: its staged files are moved into the tiers and the files it
read are removed, in any order and any number of times. Rows are never compared with rows of other runs, so equal rows that
arrive later are rows of their own. One process at a time may migrate under a root.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("planned", "committed", "published", "done")


class Store:
    """The Hadoop file system of a folder, whichever that is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, jvm = spark, root, spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def remove(self, path: str) -> bool:
        return self.fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.there(path) else []

    def sizes(self, path: str) -> Iterator[tuple[str, int]]:
        """Paths of data files below a folder, relative to it, and their bytes; listed bit by bit."""
        if not self.there(path):
            return
        top, found = str(self.fs.getFileStatus(self._path(path)).getPath().toUri().getPath()), self.fs.listFiles(self._path(path), True)
        while found.hasNext():
            status = found.next()
            at = str(status.getPath().toUri().getPath())
            if at.rpartition("/")[2].startswith("part-"):
                yield at[len(top) + 1 :], status.getLen()

    def files(self, path: str) -> Iterator[str]:
        return (at for at, _ in self.sizes(path))

    def move(self, source: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(source), self._path(to)) and not self.there(to):
            raise OSError(f"{source} can't be moved to {to}")

    def edit(self, path: str) -> None:
        """Changes one byte in the middle of a small file, for audits to find."""
        data = bytearray(self._bytes(path))
        data[len(data) // 2] ^= 1
        out = self.fs.create(self._path(path), True)
        out.write(data)
        out.close()

    def _bytes(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()

    def put(self, path: str, value: dict) -> None:
        """A small file that is there whole or not at all."""
        out = self.fs.create(self._path(f"{path}.new"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self.fs.rename(self._path(f"{path}.new"), self._path(path)) and not self.there(path):
            raise OSError(f"{path} can't be written")

    def get(self, path: str) -> dict:
        return json.loads(self._bytes(path).decode() or "{}")


class Move:
    """One run of a migration."""

    def __init__(self, store: Store, name: str | None = None):
        self.store, self.name = store, name or uuid.uuid4().hex
        self.at = f"{store.root}/_moves/{self.name}"

    def state(self) -> str | None:
        found = self.store.names(self.at)
        return next((s for s in reversed(STATES) if s in found), None)

    def mark(self, state: str, value: dict | None = None) -> None:
        self.store.put(f"{self.at}/{state}", value or {})

    def report(self) -> dict:
        return self.store.get(f"{self.at}/committed")

    def reads(self) -> DataFrame:
        """(file) of the files that the run takes rows from, as _metadata.file_path gives them."""
        return self.store.spark.read.schema("file string").parquet(f"{self.at}/reads")

    def staged(self, tier: str) -> str:
        return f"{self.at}/staged/{tier}"

    def publish(self) -> None:
        """Moves what is still staged into the tiers; file names are the run's own, so nothing is overwritten."""
        for path in list(self.store.files(f"{self.at}/staged")):
            self.store.move(f"{self.at}/staged/{path}", f"{self.store.root}/{path}")
        self.mark("published")

    def drop(self) -> int:
        """Removes the files that were read; how many were still there."""
        from urllib.parse import unquote

        removed = sum(self.store.remove(unquote(r["file"])) for r in self.reads().toLocalIterator())
        self.mark("done")
        return removed

    def roll_back(self) -> None:
        self.store.remove(self.at)


def moves(spark: SparkSession, root: str) -> list[Move]:
    """The runs under a root that aren't done; `done` ones are forgotten by the run after them."""
    store = Store(spark, root)
    found = [Move(store, name) for name in store.names(f"{root}/_moves")]
    return [m for m in found if m.state() != "done"]


def recover(spark: SparkSession, root: str) -> list[tuple[Move, int]]:
    """Takes back what wasn't committed and finishes what was; the finished runs, with the number of files that each removed."""
    store, out = Store(spark, root), []
    for name in store.names(f"{root}/_moves"):
        move = Move(store, name)
        state = move.state()
        if state in ("committed", "published"):
            move.publish()
            out.append((move, move.drop()))
        else:  # not committed, or done and of no more use
            move.roll_back()
    return out


def visible(spark: SparkSession, root: str, tier: str, running: list[Move] | None = None) -> DataFrame | None:
    """A tier's rows as the log has them: without files that a committed run has taken, with those it has staged. None without any."""
    running = [m for m in (moves(spark, root) if running is None else running) if m.state() in ("committed", "published")]
    store, parts = Store(spark, root), []
    if store.there(f"{root}/{tier}") and next(store.files(f"{root}/{tier}"), None):
        rows = spark.read.parquet(f"{root}/{tier}")
        for m in running:
            rows = rows.withColumn("_file", F.col("_metadata.file_path")).join(m.reads().withColumnRenamed("file", "_file"), "_file", "left_anti").drop("_file")
        parts.append(rows)
    for m in running:
        if m.state() == "committed" and next(store.files(m.staged(tier)), None):
            parts.append(spark.read.parquet(m.staged(tier)))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
