"""Tar shards of JSON members as a Spark data source: ``spark.read.format("json_tar")`` and ``df.write.format("json_tar")``.

The writer streams members into shards of a bounded size in a folder of the job's own, and the driver moves these to
their place once all tasks are done, so an aborted job leaves nothing. Beside each shard lies a small index: its
number of members, and the places of the members at which a reader may start, one for each SPLIT bytes. The reader plans one
task for each of these pieces from the indexes alone, so that a large shard is read by many tasks; a tar without an index is
one task, which streams it. Members pass one at a time; no task holds a shard.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

#: Bytes between the places where readers may start, and of a shard unless the option shard_mb says otherwise.
SPLIT, SHARD_MB = 64 << 20, 500.0
OVERHEAD = 512


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class Piece(InputPartition):
    """Bytes start to stop of a shard, both at the headers of members; stop None: to its end."""

    name: str
    start: int
    stop: int | None


class Section(io.RawIOBase):
    """Bytes start to stop of an open file, read forward."""

    def __init__(self, file, start: int, stop: int | None):
        self.file, self.left = file, None if stop is None else stop - start
        if start:
            file.seek(start)

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        n = n if self.left is None else min(n if n >= 0 else self.left, self.left)
        data = self.file.read(n) if n else b""
        if self.left is not None:
            self.left -= len(data)
        return data


class TarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        where, folder = at(self.path)
        files = {f.base_name for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file}
        out = []
        for name in sorted(f for f in files if f.endswith(".tar")):
            starts = [0]
            if f"{name}.idx" in files:
                with where.open_input_file(f"{folder}/{name}.idx") as f:
                    starts = json.loads(f.read())["starts"] or [0]
            out += [Piece(name, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if not partition.name:
            return
        where, folder = at(self.path)
        with where.open_input_file(f"{folder}/{partition.name}") as f, tarfile.open(fileobj=Section(f, partition.start, partition.stop), mode="r|") as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(".json") and m.name != "manifest.json":
                    yield partition.name.removesuffix(".tar"), m.name.removesuffix(".json"), tar.extractfile(m).read().decode()


@dataclass
class Written(WriterCommitMessage):
    """Names, members and bytes of the shards that a task wrote."""

    shards: list[tuple[str, int, int]]


class TarWriter(DataSourceWriter):
    def __init__(self, path: str, shard_mb: float, overwrite: bool, split: int):
        self.path, self.limit, self.overwrite, self.split = path, int(shard_mb * 1024 * 1024 * 0.98), overwrite, split
        self.job = uuid.uuid4().hex

    def own(self, folder: str) -> str:
        return f"{folder}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        where, folder = at(self.path)
        context, out = TaskContext.get(), []
        where.create_dir(self.own(folder), recursive=True)
        tar = None

        def close() -> None:
            tar.close()
            stream.close()
            with where.open_output_stream(f"{self.own(folder)}/{name}.tar.idx") as f:
                f.write(json.dumps({"members": n, "starts": starts}).encode())
            out.append((name, n, size))

        for row in iterator:
            data = row.json.encode()
            if tar and size + len(data) + OVERHEAD > self.limit:
                close()
                tar = None
            if not tar:
                # a repeated attempt writes under another name, and only what is committed moves
                name, n, size, starts = f"shard-{context.partitionId():05d}-{len(out):05d}-{self.job[:8]}-{context.taskAttemptId()}", 0, 0, []
                stream = where.open_output_stream(f"{self.own(folder)}/{name}.tar")
                tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT)
            if not starts or tar.offset - starts[-1] >= self.split:
                starts.append(tar.offset)
            info = tarfile.TarInfo(f"{row.key}.json")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            n, size = n + 1, size + len(data) + OVERHEAD
        if tar:
            close()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = at(self.path)
        shards = [s for m in messages if m for s in m.shards]
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(folder)):
                if f.is_file and f.base_name.endswith((".tar", ".tar.idx", ".manifest")):
                    where.delete_file(f.path)
        for name, _, _ in shards:
            for end in (".tar.idx", ".tar"):
                where.move(f"{self.own(folder)}/{name}{end}", f"{folder}/{name}{end}")
        with where.open_output_stream(f"{folder}/{self.job[:8]}.manifest") as f:
            f.write("".join(json.dumps({"shard": s, "n": n, "bytes": b}) + "\n" for s, n, b in shards).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = at(self.path)
        if where.get_file_info(self.own(folder)).type != fs.FileType.NotFound:
            where.delete_dir(self.own(folder))


class JsonTar(DataSource):
    """Rows (shard, key, json) of the JSON members of all tar files of a folder; written rows need key and json."""

    @classmethod
    def name(cls) -> str:
        return "json_tar"

    def schema(self) -> str:
        return "shard string, key string, json string"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options["path"], float(self.options.get("shard_mb", SHARD_MB)), overwrite, int(self.options.get("split_bytes", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonTar)
