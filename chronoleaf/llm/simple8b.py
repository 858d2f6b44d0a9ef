"""Token ids as Simple-8b words: a selector of 4 bits says how many ids of how many bits fill the other 60.

File format. A file is a Parquet row group container whose rows are segments; a segment holds consecutive
documents in ascending doc_id order: their ids back to back in blocks of BLOCK ids, each block starting on a
word of its own, with the word offset of every block, so that blocks are found and decoded independently.

- words: little-endian unsigned 64-bit integers, selector in the top 4 bits, first id in the lowest bits;
- selector 0 is the escape: its 60 bits count the plain 64-bit values that follow it;
- offsets: little-endian unsigned 32-bit, the first word of each block, then the number of words;
- doc_ids and lengths: little-endian signed and unsigned 64-bit, one per document.

Parquet is only the container, so that any store Spark can write holds the files and Spark's commit protocol
makes a lost executor's half-written file invisible.

Defined cases: a null text is an empty one and has only the end id; rows are ordered by doc_id (null first),
then by a hash of the text, so repeated doc_ids keep a fixed order and repeated rows give equal results;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches, fresh_path, partitions, written
from chronoleaf.llm.tokenize import encoder, tokenizer_path

#: Selector -> (ids in a word, bits of an id).
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
#: Ids that close a segment.
SEGMENT = 1 << 18
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"


#: Ids in a word, ascending, and the part of them whose two overlapping windows cover such a window.
COUNTS = tuple(sorted(c for c, _ in LAYOUT))
HALVES = (0, *[min(c for c in COUNTS if 2 * c >= n) for n in COUNTS[1:]])
NARROW = np.array([max(v.bit_length(), 1) for v in range(1 << 16)], np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if len(values) and int(values.max()) < len(NARROW):
        return NARROW[values]
    out = np.ones(len(values), np.uint8)
    for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        out[values >> np.uint64(bits) != 0] = bits + 1
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """uint64 values -> words and block offsets. Each word takes the layout that packs the most of the next values of its block."""
    values = values.astype(np.uint64)
    n = len(values)
    n_blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    widest = [np.full(n_blocks * block, 255, np.uint8)]
    widest[0][:n] = widths(values)
    for count, half in zip(COUNTS[1:], HALVES[1:], strict=True):
        m = widest[COUNTS.index(half)]
        wide = np.full(len(m), 255, np.uint8)
        if len(m) >= count:
            np.maximum(m[: len(m) - count + 1], m[count - half : len(m) - half + 1], out=wide[: len(m) - count + 1])
        # no word goes over the end of its block
        wide.reshape(n_blocks, block)[:, max(block - count + 1, 0) :] = 255
        widest.append(wide)
    pick = np.zeros(n, np.uint8)
    for m, (count, bits) in zip(widest, LAYOUT[::-1], strict=True):
        np.copyto(pick, LAYOUT.index((count, bits)) + 1, where=m[:n] <= bits)
    step = np.array([1, *[c for c, _ in LAYOUT]], np.uint8)[pick].tolist()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    starts = np.array(starts)
    sel = pick[starts]
    escaped = sel == 0
    where = np.cumsum(np.concatenate(([0], np.where(escaped, 2, 1))))
    words = np.zeros(where[-1], np.uint64)
    for selector in np.unique(sel[~escaped]):
        count, bits = LAYOUT[selector - 1]
        rows = sel == selector
        first, packed = starts[rows], np.full(int(rows.sum()), int(selector) << 60, np.uint64)
        for k in range(count):
            packed |= values[first + k] << np.uint64(k * bits)
        words[where[:-1][rows]] = packed
    words[where[:-1][escaped]] = 1
    words[where[:-1][escaped] + 1] = values[starts[escaped]]
    offsets = where[np.searchsorted(starts, np.arange(n_blocks) * block)]
    return words, np.append(offsets, len(words)).astype(np.uint32)


def decode_block(words: np.ndarray) -> np.ndarray:
    """Words -> values. Escapes are walked one by one; all other words are unpacked by layout at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    plain = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0).tolist():
        if not plain[i]:
            plain[i + 1 : i + 1 + int(words[i])] = True
    counts = np.array([0, *[c for c, _ in LAYOUT]], np.int64)[np.where(plain, 0, np.minimum(sel, len(LAYOUT)))]
    counts[plain] = 1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for selector, (count, bits) in enumerate(LAYOUT, 1):
        rows = np.flatnonzero((sel == selector) & ~plain)
        if len(rows):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out[starts[plain]] = words[plain]
    return out


def decode(words: np.ndarray, offsets: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks first to last (all by default): their words lie side by side and are decoded at once."""
    last = len(offsets) - 1 if last is None else last
    return decode_block(words[int(offsets[first]) : int(offsets[last])])


SEGMENTS = "shard long, before long, n_ids long, doc_ids binary, no_id binary, lengths binary, offsets binary, words binary"


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending doc_id order; gives the files' path."""
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    path = path or fresh_path(spark, "tokens")
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(partitions(spark), "doc_id", "tie")
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before, docs_here, ids_here, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4").tobytes()
        coder = encoder(tokenizer, "byte")

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(ids_here), "<u4")
            words, offsets = encode(ids)
            row = (shard, before, len(ids), np.array([d or 0 for d in docs_here], "<i8").tobytes(), np.array([d is None for d in docs_here]).tobytes(), np.array([len(x) // 4 for x in ids_here], "<u8").tobytes(), offsets.tobytes(), words.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row], names=names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = coder.one(text.as_py() or "") + end
                docs_here.append(doc_id)
                ids_here.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT:
                    yield segment()
                    before, docs_here, ids_here, size = before + size, [], [], 0
        if docs_here:
            yield segment()

    ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(pack, SEGMENTS).write.option("compression", "none").parquet(path)
    return path


DOCS = "shard long, at long, doc_id long, n_tokens long, ids_crc32 long"


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start adds a document's place in its shard to the sum of all earlier shards; there is one row per shard,
    so that sum is over as many rows as the writer had partitions.
    """
    bound_batches(spark)
    files = spark.read.schema(SEGMENTS).parquet(path)
    schema = DOCS + (", ids array<long>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker that wrote has no more use for its pieces
        for b in batches:
            for row in range(b.num_rows):
                shard, before, _, doc_ids, no_id, lengths, offsets, words = (b.column(i)[row].as_py() for i in range(8))
                ids = decode(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4")).astype("<u4")
                sizes = np.frombuffer(lengths, "<u8").astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                own = [ids[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                cols = [
                    pa.array(np.full(len(sizes), shard)),
                    pa.array(before + starts),
                    pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=np.frombuffer(no_id, bool)),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    found = files.mapInArrow(unpack, schema).coalesce(max(8, partitions(spark) // 4))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = written(shards.select("shard", base.alias("base")), "token-shards")
    out = found.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
