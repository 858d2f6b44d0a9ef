"""Sinks: item lines, tar shards of a bounded size with a manifest, the long result table."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoleaf.operators.report import RESULT_COLUMNS

OVERHEAD = 512


def write_jsonl(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: The header of an empty file, and the sum of its bytes that the name and the size do not change.
PLAIN = tarfile.TarInfo().tobuf(tarfile.USTAR_FORMAT)
REST = sum(PLAIN[:124] + PLAIN[136:148] + PLAIN[156:]) + 256
ZEROS = bytes(tarfile.RECORDSIZE)


def header(name: str, size: int) -> bytes:
    """What ``tarfile`` writes before a file of this name and size, made from one plain header unless the name needs more."""
    if not name.isascii() or len(name) > tarfile.LENGTH_NAME or "\0" in name or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT)
    start, digits = name.encode(), b"%011o\0" % size
    return b"".join((start, PLAIN[len(start) : 124], digits, PLAIN[136:148], b"%06o\0 " % (REST + sum(start) + sum(digits)), PLAIN[156:]))


def packed(held: Sequence[tuple[str, bytes]]) -> bytes:
    """A tar file of JSON members, as ``tarfile`` writes it but without an object for each member. Bytes: Arrow never lets go of a memoryview."""
    out = io.BytesIO()
    for name, data in held:
        out.write(header(f"{name}.json", len(data)))
        out.write(data)
        out.write(ZEROS[: -len(data) % tarfile.BLOCKSIZE])
    out.write(ZEROS[: 2 * tarfile.BLOCKSIZE])
    out.write(ZEROS[: -out.tell() % tarfile.RECORDSIZE])
    return out.getvalue()


def members(content: bytes | memoryview) -> Iterator[tuple[str, str]]:
    """(key, json) of the members of a tar file. Plain headers are read here; from the first that is not, ``tarfile`` reads the rest."""
    view, at = memoryview(content), 0
    while at + tarfile.BLOCKSIZE <= len(view):
        head = bytes(view[at : at + tarfile.BLOCKSIZE])
        if head == ZEROS[: tarfile.BLOCKSIZE]:  # the end
            return
        size, check = head[124:135], head[148:154]
        # as this module's headers are: a file with a sound checksum and no prefix
        plain = head[156:157] == b"0" and head[257:265] == b"ustar\x0000" and not head[345] and head[135] == 0 and size.isdigit() and check.isdigit() and sum(head) - sum(head[148:156]) + 256 == int(check, 8)
        start = at + tarfile.BLOCKSIZE
        if not plain or start + int(size, 8) > len(view):
            break
        stop = start + int(size, 8)
        yield head[:100].rstrip(b"\0").decode()[:-5], str(view[start:stop], "utf-8")
        at = stop + -(stop - start) % tarfile.BLOCKSIZE
    if at and at == len(view):  # cut off where a member ends
        return
    with tarfile.open(fileobj=io.BytesIO(view[at:]), mode="r|") as tar:
        while (m := tar.next()) is not None:
            yield m.name[:-5], tar.extractfile(m).read().decode()
            tar.members.clear()


def pack_shards(items: DataFrame, key: str, shard_mb: float = 500.0) -> DataFrame:
    """(shard, n, bytes, content): tar files of JSON members, closed before they would pass 98 % of the size.

    Greedy packing depends on the order of rows, so each partition packs its own shards; a shard is named by
    partition and place. Order within a partition is by key; rows are sorted before they become JSON, as a sort holds them.
    """
    limit = int(shard_mb * 1024 * 1024 * 0.98)
    line = F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})
    lines = items.sortWithinPartitions(F.col(key).cast("string")).select(F.col(key).cast("string").alias("key"), line.alias("json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"shard-{part:05d}-{k:05d}"]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([packed(held)], pa.binary())], names=["shard", "n", "bytes", "content"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                if held and size + len(data) + OVERHEAD > limit:
                    yield shard()
                    k, held, size = k + 1, [], 0
                held.append((name, data))
                size += len(data) + OVERHEAD
        if held:
            yield shard()

    return lines.mapInArrow(run, "shard string, n long, bytes long, content binary")


def write_shards(shards: DataFrame, path: str) -> DataFrame:
    """Writes each packed shard as <path>/<shard>.tar by the task that holds it; returns the manifest, read from its file.

    A repeated task writes the same bytes to the same name again, so a lost executor does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                with where.open_output_stream(f"{folder}/{name}.tar") as out:
                    out.write(content.as_buffer())
            yield b.select(["shard", "n", "bytes"])

    made = shards.select("shard", "n", "bytes", "content").mapInArrow(run, "shard string, n long, bytes long")
    made.write.mode("overwrite").json(f"{path}/manifest")
    return shards.sparkSession.read.schema("shard string, n long, bytes long").json(f"{path}/manifest")


def unpack_shards(shards: DataFrame) -> DataFrame:
    """(shard, key, json) of the members of packed shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = [(name, key, text) for key, text in members(memoryview(content.as_buffer()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["shard", "key", "json"])

    return shards.select("shard", "content").mapInArrow(run, "shard string, key string, json string")


def manifest(shards: DataFrame) -> DataFrame:
    return shards.select("shard", "n", "bytes")


def write_long_csv(rows: DataFrame, path: str) -> None:
    """The fixed columns in order, empty where missing."""
    cols = [(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in RESULT_COLUMNS]
    rows.select(*cols).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_frame_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("video_id").parquet(path)
