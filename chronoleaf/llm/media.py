"""Media columns: texts as 8-bit grey PNG images in a binary column, read back and hashed by content.

``encode_png`` and ``decode_png`` write and read the PNG chunk layout with zlib; scanlines are filtered and
unfiltered by numpy, and every chunk's checksum is tested when read. ``image_hash`` shrinks an image to
32 x 32 cells by exact integer area means and keeps the signs of its low-frequency cosine coefficients;
all sums are integers, so equal payloads give equal hashes on any machine.

Defined cases: a null or empty text becomes one row block of 255s; repeated rows give repeated results;
other columns are ignored; an empty table gives an empty table. A row is handled at a time, so memory
is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoleaf.llm.common import bound_batches, written

UNIT = 576
WIDTH = 96
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT)), len(raw)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(data: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """Grey 8-bit PNG of rows of ``width`` samples, unfiltered or filtered, whichever is smaller.

    Filtered: per row, the filter none, sub or up of the least absolute sum.
    """
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    options = np.stack((rows, left, up))
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = options[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    plain = np.zeros_like(lines)
    plain[:, 1:] = rows
    body = min((zlib.compress(x.tobytes(), level) for x in (plain, lines)), key=len)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the five scanline filters of 8-bit grey images; runs of one filter go as blocks where they can."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    above = np.zeros(out.shape[1], np.uint8)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind = int(kinds[a]) if b > a else 0
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            out[a] += above
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for i in range(a, b):
                prior = [int(v) for v in (out[i - 1] if i else above)]
                row, west, corner = out[i].tolist(), 0, 0
                for j, north in enumerate(prior):
                    if kind == 3:
                        guess = (west + north) >> 1
                    else:
                        p = west + north - corner
                        guess = min((abs(p - west), 0, west), (abs(p - north), 1, north), (abs(p - corner), 2, corner))[2]
                    west = row[j] = (row[j] + guess) & 255
                    corner = north
                out[i] = row
        elif kind > 4:
            raise ValueError(f"filter type {kind}")
        if b > a:
            above = out[b - 1]
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples, as rows. Raises ValueError if the signature, a checksum or the size is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, packed = 8, None, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if shape is None:
        raise ValueError("no header")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    return unfilter(lines.reshape(shape[0], shape[1] + 1))


CELLS, LOW = 32, 8
_k, _x = np.arange(LOW)[:, None], np.arange(CELLS)[None, :]
#: Cosines as integers, so that the transform is exact.
COSINES = np.rint(np.cos(np.pi * (2 * _x + 1) * _k / (2 * CELLS)) * 4096).astype(np.int64)


def shrink(image: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Integer means over cells x cells areas; an axis shorter than that repeats its rows."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n < cells:
            image = np.take(image, np.arange(cells) * n // cells, axis=axis)
        else:
            starts = np.arange(cells) * n // cells
            sums = np.add.reduceat(image.astype(np.int64), starts, axis=axis)
            sizes = np.diff(np.append(starts, n))
            image = sums * 16 // (sizes[:, None] if axis == 0 else sizes[None, :])
    return image.astype(np.int64)


def image_hash(image: np.ndarray) -> bytes:
    """8 bytes: signs of the 63 lowest cosine coefficients against their median; the constant one is left out."""
    low = (COSINES @ shrink(image) @ COSINES.T).ravel()[1:]
    bits = low > np.sort(low)[len(low) // 2]
    return np.packbits(np.append(bits, False)).tobytes()


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (PNG) of each row of ``docs``, written to the shared folder and read back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                made = [payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(p) for p, _ in made], pa.binary())], schema=MEDIA)

    bound_batches(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary"), "media")


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the content hash (hex) of each stored image, from its decoded samples."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                rows = []
                for stored in part.column(2).to_pylist():
                    image = decode_png(stored)
                    data = image.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), image_hash(image).hex()))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    bound_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)
