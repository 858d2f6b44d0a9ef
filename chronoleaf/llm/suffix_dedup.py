"""Repeated passages by suffix arrays: bytes covered by a string of LENGTH bytes that a smaller doc_id also holds.

1. Anchors. The least hash of the K-byte strings in each window of LENGTH bytes depends on the window alone, so
   equal windows share it: their anchor. Anchors go to buckets of their hashes as packed arrays. A bucket keeps
   those whose left or right neighbourhood another text shares, and names the anchor's source: the least
   document that has it and its place there. Of a hash that a batch of documents holds more than OFTEN times, in few
   neighbourhoods, only what decides goes to the bucket (per neighbourhood the least and greatest text and the least
   document); the batch's anchors stay packed together until the bucket's reply to that batch is joined to them.
2. Blocks. Around its shared anchors a document is cut into regions, one per STRETCH bytes of a source; equal
   windows of two documents have the same anchor, so they meet in a block. Equal regions are sorted out before the
   shuffle: of those a task holds, all but the least document's are repeats as a whole, and only that one goes on.
3. Suffix arrays. The regions of a block are split into words with the white space that ends them; no such word
   is a prefix of another, so suffixes in word order are in byte order. Their suffix array (linear grouping,
   ``suffix_array``) and the bytes that neighbours share give, for each window, all regions that hold it, and
   the least document among them. Windows inside words of over LEFT bytes get a suffix array over bytes.
4. Blocks beyond LARGE bytes, which a passage in very many surroundings makes, are cut again by single anchors.
   What is beyond LARGE even then is not gathered: its distinct regions give a hash of every window, and the least
   document per hash is aggregated like any sum.

All of a text that equals one of a smaller doc_id goes if it has LENGTH bytes. A document is known by its doc_id
and a hash of its text, so rows that repeat a doc_id have a result each.

Defined cases: a null text is empty and keeps nothing; a null doc_id takes no part, its row keeps all; repeated
rows of one doc_id are not copies of each other, whether their texts are equal or not, and each gives one row;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches, discard, partitions, written
from chronoleaf.llm.minhash import GOLD, mix
from chronoleaf.llm.suffix_array import suffix_array

LENGTH, K, SIDE = 50, 20, 15
SPREAD = LENGTH - K + 1
STRETCH, LARGE, LEFT, TOGETHER = 256, 4 << 20, 25, 1 << 19
#: Anchors, and bytes of regions, that a task holds before it sends them off.
HELD, HELD_BYTES = 1 << 19, 16 << 20
#: A hash that is more often among the held anchors, and at least FEWER times as often as what decides, is sent by that alone.
OFTEN, FEWER = 256, 8
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` consecutive values."""
    best, done = np.minimum if least else np.maximum, 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def grams(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the given sizes."""
    powers, factor, size = {1: data.astype(np.uint64) + np.uint64(1)}, {1: GOLD}, 1
    while size * 2 <= max(sizes):
        x, f = powers[size], factor[size]
        powers[2 * size], factor[2 * size] = x[:-size] * f + x[size:], np.uint64(int(f) ** 2 % 2**64)
        size *= 2
    out = {}
    for want in sizes:
        at, whole = 0, None
        for part in sorted(powers, reverse=True):
            while want - at >= part:
                piece = powers[part][at : len(data) - want + at + 1]
                whole = piece if whole is None else whole * factor[part] + piece
                at += part
        out[want] = mix(whole)
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes, and hashes of SIDE bytes to the left and right (0: the text ends there) of a text's anchors."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none.astype(np.uint16), none.astype(np.uint16)
    hashes = grams(data, (K, SIDE))
    h, side = hashes[K], hashes[SIDE]
    least = slide(h, SPREAD, True)
    pad = np.zeros(SPREAD - 1, np.uint64)
    chosen = np.flatnonzero(slide(np.concatenate((pad, least, pad)), SPREAD, False) == h)
    near = ((side >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    left = np.where(chosen >= SIDE, near[np.maximum(chosen - SIDE, 0)], 0).astype(np.uint16)
    ends = chosen + K
    right = np.where(ends + SIDE <= len(data), near[np.minimum(ends, len(near) - 1)], 0).astype(np.uint16)
    return chosen, h[chosen], left, right


def packed(ids: np.ndarray, tags: np.ndarray, which: np.ndarray, *more: np.ndarray) -> bytes:
    """Anchors as bytes: their documents once, then an index into these and the other columns."""
    used, local = np.unique(which, return_inverse=True)
    head = np.array([len(used), len(which)], "<u4").tobytes()
    return head + b"".join(x.tobytes() for x in (ids[used], tags[used], local.astype("<u4"), *more))


def unpacked(blob: bytes, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """doc and text hash of each anchor, and its other columns."""
    n_docs, n = np.frombuffer(blob, "<u4", 2).tolist()
    at, out = 8, []
    for kind, count in (("<i8", n_docs), ("<i8", n_docs), ("<u4", n), *((k, n) for k in kinds)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    ids, tags, local, *rest = out
    return (ids[local], tags[local], *rest)


#: Columns of anchors in a bucket (place, hash there, left, right), and of those that stay with their batch.
SENT, STAYED = ("<u4", "<u4", "<u2", "<u2"), ("<u4", "<u8", "<u2", "<u2")


def edges_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows in the order of ``keys`` start a new one."""
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate(([True], new)))


def deciding(key: np.ndarray, side: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows with the least and greatest text and the least document and place of each (key, side)."""
    out = []
    for order in (np.lexsort((tag, side, key)), np.lexsort((pos, doc, side, key))):
        first = edges_of(key[order], side[order])
        out += [order[first], order[np.append(first[1:], len(order)) - 1]]
    return np.concatenate(out[:3])


def anchor_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, tag, text) -> (bucket, batch, stays, blob): anchors of some documents by bucket of their hash.

    batch is null but where a blob has what decides for a batch, or (stays) the anchors of one.
    """
    names = ["bucket", "batch", "stays", "blob"]

    def sent(ids: list[int], tags: list[int], parts: list[tuple], batch: int) -> pa.RecordBatch:
        which, pos, h, left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
        id_of, tag_of = np.array(ids, "<i8"), np.array(tags, "<i8")
        key = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        which, pos, key, left, right = (x[order] for x in (which, pos, key, left, right))
        first = edges_of(key)
        sizes = np.diff(np.append(first, len(key)))
        often = np.repeat(sizes > OFTEN, sizes)
        rows: list[tuple] = []

        def send(chosen: np.ndarray, of: int | None) -> None:
            bucket = key[chosen] >> np.uint64(32)
            for part in np.split(chosen, edges_of(bucket)[1:]):
                rows.append((int(key[part[0]] >> np.uint64(32)), of, False, packed(id_of, tag_of, which[part], pos[part].astype("<u4"), key[part].astype("<u4"), left[part].astype("<u2"), right[part].astype("<u2"))))

        many, decide = np.flatnonzero(often), first[:0]
        if len(many):
            doc, tag = id_of[which[many]], tag_of[which[many]]
            decide = many[np.unique(np.concatenate([deciding(key[many], side[many], doc, tag, pos[many]) for side in (left, right)]))]
            group = np.repeat(np.arange(len(first)), sizes)
            often &= (FEWER * np.bincount(group[decide], minlength=len(first)) <= sizes)[group]
            many, decide = np.flatnonzero(often), decide[often[decide]]
        few = np.flatnonzero(~often)
        if len(few):
            send(few, None)
        if len(many):
            send(decide, batch)
            rows.append((batch % buckets, batch, True, packed(id_of, tag_of, which[many], pos[many].astype("<u4"), key[many].astype("<u8"), left[many].astype("<u2"), right[many].astype("<u2"))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, tags, parts, held, batch = [], [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if doc_id is None or len(raw) < LENGTH:
                    continue
                pos, h, left, right = anchors(np.frombuffer(raw, np.uint8))
                parts.append((np.full(len(pos), len(ids), np.uint32), pos.astype(np.uint32), h, left, right))
                ids.append(doc_id)
                tags.append(tag)
                held += len(pos)
                if held >= HELD:
                    yield sent(ids, tags, parts, batch)
                    ids, tags, parts, held, batch = [], [], [], 0, batch + 1
        if ids:
            yield sent(ids, tags, parts, batch)

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "bucket int, batch long, stays boolean, blob binary")


def several(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row, whether its key has another value."""
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], values[order]
    edges = edges_of(k)
    many = np.maximum.reduceat(v, edges) != np.minimum.reduceat(v, edges)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(many, np.diff(np.append(edges, len(keys))))
    return out


ANCHORS = "doc long, tag long, pos int, source long, place int"
#: ANCHORS; for a reply also its batch, the anchor's hash, neighbourhoods and which of them are shared; or anchors that stayed.
MET = ANCHORS + ", batch long, key long, left int, right int, by_left boolean, by_right boolean, blob binary"


def met_anchors(blobs: DataFrame, buckets: int) -> DataFrame:
    """anchor_blobs -> MET. A bucket's anchors are held at once: a share of all of them. Of a frequent hash they hold
    only what decides, unless that is over a FEWERth of it: a hash in very many neighbourhoods comes whole.
    """
    names = [x.split()[0] for x in MET.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for bucket, batch, stays, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if stays:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*[None] * 5, batch, *[None] * 5, blob.as_py()], kinds, strict=True)], names=names)
                    continue
                columns = unpacked(blob.as_py(), SENT)
                by.setdefault(bucket, []).append((*columns, np.full(len(columns[0]), -1 if batch is None else batch)))
        for bucket in sorted(by):
            doc, tag, pos, h, left, right, batch = (np.concatenate(c) for c in zip(*by.pop(bucket), strict=True))
            wide = h.astype(np.uint64) << np.uint64(16)
            shared = []
            for side in (left, right):
                met, rows = np.zeros(len(doc), bool), np.flatnonzero(side)
                if len(rows):
                    met[rows] = several(wide[rows] | side[rows], tag[rows])
                shared.append(met)
            either = shared[0] | shared[1]
            # each hash's source: the least document and place of its met anchors
            order = np.lexsort((pos, doc, ~either, h))
            first = edges_of(h[order])
            sizes = np.diff(np.append(first, len(order)))
            source, place = np.empty_like(doc), np.empty_like(pos)
            source[order], place[order] = np.repeat(doc[order][first], sizes), np.repeat(pos[order][first], sizes)
            # anchors that no reply is for: met ones, of copies only the least document's
            plain = np.flatnonzero(either & (batch < 0))
            order = plain[np.lexsort((doc[plain], tag[plain], pos[plain], h[plain]))]
            keep = order[edges_of(h[order], pos[order], tag[order])] if len(order) else order
            for rows, reply in ((keep, False), (np.flatnonzero(batch >= 0), True)):
                for a in range(0, len(rows), 50_000):
                    r = rows[a : a + 50_000]
                    own = [doc[r], tag[r], pos[r].astype(np.int32), source[r], place[r].astype(np.int32)]
                    more = [batch[r], h[r].astype(np.int64) | bucket << 32, left[r].astype(np.int32), right[r].astype(np.int32), shared[0][r], shared[1][r]]
                    columns = [*own, *(more if reply else [None] * 6), None]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(r), t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return blobs.repartitionById(buckets, "bucket").mapInArrow(run, MET)


def shared_anchors(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """ANCHORS: one row per anchor of a document that another text shares with a neighbourhood; and the table it reads."""
    met = written(met_anchors(anchor_blobs(docs, buckets), buckets), "met-anchors")
    reply = F.struct("key", "left", "right", "by_left", "by_right", "source", "place")
    replies = met.filter("batch is not null and blob is null").groupBy("batch").agg(F.collect_list(reply).alias("replies"))
    stayed = met.filter("blob is not null").select(F.col("batch").alias("b"), "blob").join(replies, F.col("b") == F.col("batch")).select("blob", "replies")
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, tag, pos, key, left, right = unpacked(b.column(0)[i].as_py(), STAYED)
                told = b.column(1)[i].values
                of, k_left, k_right, by_left, by_right, source, place = (told.field(c).to_numpy(zero_copy_only=False) for c in range(7))
                of = of.astype(np.uint64)
                wide, met = key << np.uint64(16), np.zeros(len(key), bool)
                for side, k_side, by in ((left, k_left, by_left), (right, k_right, by_right)):
                    known = (of << np.uint64(16) | k_side.astype(np.uint64))[by.astype(bool)]
                    met |= np.isin(wide | side, known)
                at, where = np.unique(of, return_index=True)
                found = where[np.searchsorted(at, key)]
                columns = (doc, tag, pos.astype(np.int32), source[found], place[found].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], names=names)

    plain = met.filter("batch is null and blob is null").select(*names)
    return plain.union(stayed.mapInArrow(run, ANCHORS)), met


REGIONS = "block long, coarse long, doc long, tag long, start int, stop int, body binary"


def regions(candidates: DataFrame, fine: bool = False) -> DataFrame:
    """candidates (doc, tag, text, found: array of (pos, source, place)) -> REGIONS; without a body: a repeat as a whole.

    fine: a block has one anchor, not those of a stretch; ``coarse`` is the block it would be in otherwise.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in REGIONS.split(", ")]

    def sent(held: dict[tuple[int, bytes], list[tuple]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (block, body), holders in held.items():
            least = min(h[1] for h in holders)
            for coarse, doc, tag, start in holders:
                rows.append((block, coarse, doc, tag, start, start + len(body), body if doc == least else None))
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[tuple]] = {}
        size = 0
        for b in batches:
            for i, (doc, tag, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                pos, source, place = (c.to_numpy(zero_copy_only=False) for c in b.column(3)[i].values.flatten())
                block_of = lambda at: mix(mix(source.astype(np.uint64) * GOLD + np.uint64(1)) + at.astype(np.uint64)).view(np.int64)  # noqa: B023, E731
                coarse = block_of(place // STRETCH)
                block = block_of(place.astype(np.int64) + (1 << 40)) if fine else coarse
                order = np.lexsort((pos, block))
                pos, block, coarse = pos[order].astype(np.int64), block[order], coarse[order]
                low, high = np.maximum(pos - (SPREAD - 1), 0), np.minimum(pos + LENGTH, len(raw))
                new = np.concatenate(([True], (block[1:] != block[:-1]) | (low[1:] > high[:-1])))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(pos)) - 1
                for k, c, s, e in zip(block[first].tolist(), coarse[first].tolist(), low[first].tolist(), high[last].tolist(), strict=True):
                    if e - s >= LENGTH:
                        body = raw[s:e]
                        if (k, body) not in held:
                            size += e - s
                        held.setdefault((k, body), []).append((c, doc, tag, s))
                        size += 64
                if size >= HELD_BYTES:
                    yield from sent(held)
                    held, size = {}, 0
        if held:
            yield from sent(held)

    return candidates.mapInArrow(run, REGIONS)


def neighbours(data: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, at most ``most``, that each suffix shares with the one before it in order; none goes past its region's end."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    padded = np.concatenate((data, np.zeros(most, np.uint8)))
    window = np.lib.stride_tricks.sliding_window_view(padded, most)
    for a in range(1, len(order), 20_000):
        x, y = order[a - 1 : min(a + 19_999, len(order) - 1)], order[a : a + 20_000]
        differ = window[x] != window[y]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        out[a : a + 20_000] = np.minimum(common, np.minimum(ends[x] - x, ends[y] - y))
    return out


def least_by(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row, the least value among the rows of its key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    out = np.empty(len(values), values.dtype)
    out[order] = np.repeat(np.minimum.reduceat(values[order], edges), np.diff(np.append(edges, len(k))))
    return out


def least_documents(bodies: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each byte of the concatenated bodies, the least document that holds the window that starts there.

    ``docs`` has the least document of each body. Where no whole window starts, the value is the own document.
    """
    sizes = np.array([len(x) for x in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    n = len(data)
    stops = np.cumsum(sizes)
    ends, begins = np.repeat(stops, sizes), np.repeat(stops - sizes, sizes)
    own = np.repeat(docs, sizes)
    best = own.copy()
    white = WHITE[data]
    at = np.arange(n)
    whole = at + LENGTH <= ends
    # the first white space at or after each position
    space = np.minimum.accumulate(np.where(white, at, n)[::-1])[::-1]
    left = space + 1 - at
    by_word = whole & (left <= LEFT)

    def grouped(suffixes: np.ndarray, shared: np.ndarray, lefts: range, allowed: np.ndarray) -> None:
        rank_of = np.full(n + 1, -1, np.int64)
        rank_of[suffixes] = np.arange(len(suffixes))
        code = np.zeros(n, np.uint64)
        for x in lefts:
            # windows that start x bytes before a suffix: the suffix's first bytes are alike, and these x bytes
            if x:
                code[: n - x + 1] = data[: n - x + 1].astype(np.uint64) + np.uint64(1) + GOLD * (code[1 : n - x + 2] if x > 1 else np.uint64(0))
            starts = np.flatnonzero(allowed & (left == x if lefts.stop > 1 else True))
            if not len(starts):
                continue
            run = np.cumsum(shared < LENGTH - x)[rank_of[starts + x]]
            key = mix(run.astype(np.uint64) * GOLD + mix(code[starts]))
            best[starts] = np.minimum(best[starts], least_by(key, own[starts]))

    heads = np.flatnonzero(np.concatenate(([True], white[:-1])) | (at == begins))
    cuts = np.append(heads, n).tolist()
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rank = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    # a separator, lower than all words, stands before each body
    first = np.flatnonzero(begins[heads] == heads)
    symbols = np.insert(np.fromiter(map(rank.__getitem__, words), np.int64, len(words)), first, 0)
    positions = np.insert(heads, first, -1)
    order = positions[suffix_array(symbols)]
    order = order[order >= 0]
    grouped(order, neighbours(data, ends, order), range(1, LEFT + 1), by_word & (at + left < ends))
    rest = np.flatnonzero(whole & ~by_word)
    if len(rest):
        # bytes of the windows that start inside long words, with a separator before each stretch of them
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, rest, 1)
        np.add.at(covered, rest + LENGTH, -1)
        inside = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        breaks = np.flatnonzero(np.concatenate(([True], (np.diff(inside) > 1) | (begins[inside][1:] != begins[inside][:-1]))))
        order = np.insert(inside, breaks, -1)[suffix_array(np.insert(data[inside].astype(np.int64) + 1, breaks, 0))]
        keep = np.zeros(n, bool)
        keep[rest] = True
        order = order[order >= 0]
        order = order[keep[order]]
        grouped(order, neighbours(data, ends, order), range(0, 1), keep)
    return best


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by windows at ascending starts."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > LENGTH)))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1] + LENGTH


FOUND = "doc long, tag long, a array<int>, b array<int>"


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "tag", "a", "b"])


def repeats_in_blocks(table: DataFrame) -> DataFrame:
    """REGIONS -> FOUND, by a suffix array of several blocks at a time, up to TOGETHER bytes of distinct regions."""

    def work(held: dict[bytes, list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
        bodies = list(held)
        docs = np.array([min(h[0] for h in held[x]) for x in bodies], np.int64)
        best = least_documents(bodies, docs)
        rows, at = [], 0
        for body, least in zip(bodies, docs.tolist(), strict=True):
            part = best[at : at + max(len(body) - LENGTH + 1, 0)]
            at += len(body)
            hits = np.flatnonzero(part < least)
            own = spans(hits) if len(hits) else (hits, hits)
            for doc, tag, start in held[body]:
                a, b = own if doc == least else (np.zeros(1, np.int64), np.full(1, len(body)))
                if len(a):
                    rows.append((doc, tag, (a + start).astype(np.int32), (b + start).astype(np.int32)))
        if rows:
            yield found_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, int, int]]] = {}
        size, last = 0, None
        for b in batches:
            for block, doc, tag, start, body in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4), strict=True):
                if size >= TOGETHER and block != last:
                    yield from work(held)
                    held, size = {}, 0
                last, body = block, body.as_py()
                if body not in held:
                    held[body] = []
                    size += len(body)
                held[body].append((doc, tag, start))
        if held:
            yield from work(held)

    rows = table.select("block", "doc", "tag", "start", "body")
    return rows.repartition(partitions(table.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, FOUND)


def repeats_by_hash(table: DataFrame) -> DataFrame:
    """REGIONS of large blocks -> FOUND, by the least document of each window's 128-bit hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(big.num_rows):
                body = big.column(0)[i].as_py()
                made = [xxhash.xxh3_128_digest(body[p : p + LENGTH]) for p in range(len(body) - LENGTH + 1)]
                n = len(made)
                yield pa.RecordBatch.from_arrays([pa.array([big.column(1)[i].as_py()] * n, pa.int64()), pa.array([big.column(2)[i].as_py()] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(made, pa.binary())], names=["doc", "text_hash", "at", "window"])

    keyed = table.withColumn("text_hash", F.unhex(F.sha2("body", 256)))
    distinct = written(keyed.groupBy("body", "text_hash").agg(F.min("doc").alias("doc")).select("body", "doc", "text_hash"), "large-regions")
    made = written(distinct.mapInArrow(windows, "doc long, text_hash binary, at int, window binary"), "large-windows")
    least = written(made.groupBy(F.col("window").alias("w")).agg(F.min("doc").alias("least")), "large-least")
    per = made.join(least, F.col("window") == F.col("w")).groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("windows"))
    rows = keyed.select("doc", "tag", "start", "text_hash").join(per.withColumnRenamed("text_hash", "t"), F.col("text_hash") == F.col("t"))
    hits = F.filter("windows", lambda w: w["least"] < F.col("doc"))
    return rows.select("doc", "tag", F.transform(hits, lambda w: w["at"] + F.col("start")).alias("a"), F.transform(hits, lambda w: w["at"] + F.col("start") + LENGTH).alias("b")).filter(F.size("a") > 0)


def large_blocks(table: DataFrame) -> DataFrame:
    n = table.groupBy("block").agg(F.sum(F.octet_length("body")).alias("n")).filter(F.col("n") > LARGE)
    return written(n.select(F.col("block").alias("k")), "large-blocks", True)


def repeats(candidates: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """candidates of ``regions`` -> FOUND: all spans that a smaller doc_id holds as well; and the tables it reads."""
    whole = lambda t: t.filter("body is null").select("doc", "tag", F.array("start").alias("a"), F.array("stop").alias("b"))
    within = lambda t, column, large, how: t.join(large, F.col(column) == F.col("k"), how)
    table = written(regions(candidates), "regions")
    out, left = whole(table), table.filter("body is not null")
    big = large_blocks(left)
    tables = [table, big]
    if big.limit(1).count():
        out = out.union(repeats_in_blocks(within(left, "block", big, "left_anti")))
        again = within(left, "block", big, "left_semi").select(F.col("doc").alias("d"), F.col("tag").alias("t")).distinct()
        again = candidates.join(again, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t")), "left_semi")
        table = written(within(regions(again, True), "coarse", big, "left_semi"), "fine-regions")
        out, left = out.union(whole(table)), table.filter("body is not null")
        big = large_blocks(left)
        tables += [table, big]
        if big.limit(1).count():
            out = out.union(repeats_by_hash(within(left, "block", big, "left_semi")).select("doc", "tag", "a", "b"))
            left = within(left, "block", big, "left_anti")
    return out.union(repeats_in_blocks(left)), tables


RESULT = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(candidates: DataFrame, with_text: bool) -> DataFrame:
    """candidates (doc, tag, text, a: array of arrays, b) -> RESULT of those documents, with the kept bytes if asked for."""
    schema = RESULT + (", kept binary" if with_text else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 256):
                part = big.slice(start, 256)
                rows = []
                for doc, tag, text, xs, ys in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    runs: list[list[int]] = []
                    for x, y in sorted((p, q) for c, d in zip(xs, ys, strict=True) for p, q in zip(c, d, strict=True)):
                        if runs and x <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], y)
                        else:
                            runs.append([x, y])
                    edges = [0, *[v for r in runs for v in r], len(raw)]
                    kept = b"".join(raw[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc, tag, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return candidates.mapInArrow(run, schema)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """RESULT of each row of ``docs``; with_text adds the kept bytes of the documents that lose some."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.coalesce("text", F.lit(""))
    tagged = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    rows = written(tagged.select("doc_id", "tag", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "texts")
    reps = written(rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("rep")), "text-classes")

    shared, met = shared_anchors(tagged, partitions(spark))
    found = shared.groupBy("doc", "tag").agg(F.collect_list(F.struct("pos", "source", "place")).alias("found"))
    found = written(found, "shared-anchors")
    discard(met)
    same = lambda doc, tag: (F.col("d") == F.col(doc)) & (F.col("t") == F.col(tag))
    texts = tagged.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "text").filter("text is not null")
    candidates = written(texts.join(found.hint("shuffle_hash"), same("doc", "tag")).select("doc", "tag", "text", "found"), "candidates")
    discard(found)
    hits, tables = repeats(candidates)
    hits = hits.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    hits = written(hits, "repeats")
    discard(*tables)
    changed = remove(candidates.join(hits.hint("shuffle_hash"), same("doc", "tag")).select("doc", "tag", "text", "a", "b"), with_text)
    # rows that repeat a doc_id with its text have one result
    changed = changed.dropDuplicates(["doc_id", "tag"]).select(*[F.col(c).alias(f"c_{c}") for c in changed.columns])
    x = rows.join(reps.withColumnRenamed("sha", "s"), F.col("sha") == F.col("s"), "left").select("doc_id", "tag", "n_bytes", "sha", "rep")
    x = x.join(changed, (F.col("doc_id") == F.col("c_doc_id")) & (F.col("tag") == F.col("c_tag")), "left")
    copy = F.coalesce((F.col("rep") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH), F.lit(False))

    def pick(when_copy: Column, name: str, otherwise: Column) -> Column:
        return F.when(copy, when_copy).otherwise(F.coalesce(F.col(f"c_{name}"), otherwise)).alias(name)

    out = [
        F.col("doc_id"),
        F.col("n_bytes"),
        pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")),
        pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")),
    ]
    return x.select(*out, *([F.when(copy, F.lit(b"")).otherwise(F.col("c_kept")).alias("kept")] if with_text else []))
