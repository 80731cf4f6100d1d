"""A topic in a shared folder, as a Spark data source: it stands in for a broker where there is none.

root/<topic>/partition=<p>/<first offset>-<count>.jsonl: JSON lines with key and value. Register with register(spark); then
spark.readStream.format("topic").option("path", root).option("topic", name) and writeStream.format("topic") with the same options and "writer", a
name that stays the same when the query is started again.

Readers keep offsets by partition, and a batch reads exactly the lines from its start to its end offsets. Writers' tasks write files aside and
name them in their commit messages; the driver then notes which offsets they get and moves them there. A batch that is committed again finds its
note and does the same moves again, so each row is there once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, partition int, offset long"


class Folder:
    """Files of a topic, in any store that Arrow's file systems reach."""

    def __init__(self, options: dict):
        from pyarrow import fs

        path = options["path"]
        self.fs, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.root = f"{root.rstrip('/')}/{options['topic']}"

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True)))

    def segments(self, partition: int) -> list[tuple[int, int, str]]:
        """(first offset, offset after the last, path) of a partition's files, in order."""
        out = []
        for name in self.names(f"partition={partition}"):
            if name.endswith(".jsonl"):
                first, count = map(int, name[: -len(".jsonl")].split("-"))
                out.append((first, first + count, f"{self.root}/partition={partition}/{name}"))
        return out

    def ends(self) -> dict[str, int]:
        found = [int(n.partition("=")[2]) for n in self.names("") if n.startswith("partition=")]
        return {str(p): max((end for _, end, _ in self.segments(p)), default=0) for p in sorted(found)}

    def there(self, path: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(path).type != fs.FileType.NotFound

    def write(self, path: str, data: bytes) -> None:
        """Whole or not at all."""
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}.new"
        with self.fs.open_output_stream(aside) as out:
            out.write(data)
        self.fs.move(aside, path)

    def read(self, path: str) -> Iterator[bytes]:
        with self.fs.open_input_stream(path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from lines
            if rest:
                yield rest


@dataclass
class Span(InputPartition):
    partition: int
    start: int
    end: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        """The earliest."""
        return {}

    def latestOffset(self) -> dict:
        return Folder(self.options).ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Span(int(p), start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        folder = Folder(self.options)
        for first, after, path in folder.segments(partition.partition):
            if after <= partition.start or first >= partition.end:
                continue
            for offset, line in enumerate(folder.read(path), first):
                if partition.start <= offset < partition.end:
                    row = json.loads(line)
                    yield row.get("key"), row.get("value"), partition.partition, offset

    def commit(self, end: dict) -> None:
        """A topic keeps its lines."""


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceStreamWriter):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names
        self.partitions = int(options.get("partitions", 1))

    def write(self, rows: Iterator) -> Written:
        """This task's rows by partition of the topic, each in a file aside. Equal keys go to one partition, rows without a key to the first."""
        import zlib

        folder, lines = Folder(self.options), {}
        for row in rows:
            values = dict(zip(self.names, row))
            key = values.get("key")
            lines.setdefault(zlib.crc32(key.encode()) % self.partitions if key is not None else 0, []).append(json.dumps({"key": key, "value": values.get("value")}).encode())
        files = []
        for p, own in lines.items():
            path = f"{folder.root}/_aside/{uuid.uuid4().hex}.jsonl"
            folder.write(path, b"\n".join(own))
            files.append((p, len(own), path))
        return Written(files)

    def commit(self, messages: list, batchId: int) -> None:
        folder = Folder(self.options)
        note = f"{folder.root}/_commits/{self.options['writer']}-{batchId}.json"
        if not folder.there(note):
            ends, moves = folder.ends(), []
            for p, count, path in sorted(f for m in messages if m is not None for f in m.files):
                first = ends.get(str(p), 0)
                moves.append((path, f"{folder.root}/partition={p}/{first:020d}-{count}.jsonl"))
                ends[str(p)] = first + count
            folder.write(note, json.dumps(moves).encode())
        else:
            self.abort(messages, batchId)  # the rows are those of the note
        for source, to in json.loads(b"".join(folder.read(note)) or b"[]"):
            if folder.there(source):
                folder.fs.create_dir(to.rpartition("/")[0], recursive=True)
                folder.fs.move(source, to)

    def abort(self, messages: list, batchId: int) -> None:
        folder = Folder(self.options)
        for _, _, path in (f for m in messages if m is not None for f in m.files):
            if folder.there(path):
                folder.fs.delete_file(path)


class Topic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return Writer(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Topic)
