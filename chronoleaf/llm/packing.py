"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Sequences hold at most SIZE tokens and only their pieces' lengths matter, so the instance is the histogram of
piece lengths: SIZE numbers, however many documents there are. A chromosome is a multiset of bins, kept as
(pattern of lengths, how many bins have it). Crossover injects whole well-filled bins of one parent into the
other and takes out bins that would hold the same pieces again. Displaced pieces first take the place of smaller
ones wherever that fills a bin better; what is displaced then goes back by best fit in descending length. Islands
evolve populations in separate tasks, each until STALE children in turn have saved no bin; after each epoch every
island gets the elite of the one before it. The search ends with an epoch that saves no bin, or at a lower bound
that no plan can beat. The best plan is then dealt to the pieces by their rank among those of their length:
counters per input partition, their prefix sums, and a lookup in the plan, so no task gathers a length.

Bounds: a histogram has at most SIZE lengths. Best fit leaves at most two patterns more per length, and children of
more than MOST patterns die, so a plan has at most MOST patterns whatever the input. Histogram, plans (one per island
and epoch) and the best plan's lookup are the only things that reach the driver or are broadcast. Pieces are never
gathered by length or sorted globally.

Defined cases: a null or empty text is the end id alone, one piece; repeated rows are separate documents;
null doc_ids are kept; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches, written
from chronoleaf.llm.tokenize import encoder, tokenizer_path

SIZE = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
ISLANDS, POPULATION = 4, 4
#: Children in turn that save no bin and end an epoch; most distinct patterns of a plan; pieces of bins whose pairs are tried.
STALE, MOST, PAIRED = 16, 4 * SIZE, 6

#: (length, pieces of it in a bin), in descending order of length.
Pattern = tuple[tuple[int, int], ...]
#: (pattern, how many bins have it).
Plan = list[tuple[Pattern, int]]


def fill(pattern: Pattern) -> int:
    return sum(x * k for x, k in pattern)


def best_fit(counts: dict[int, int], open_bins: Iterable[tuple[Pattern, int]] = (), size: int = SIZE) -> Plan:
    """Best fit in descending length, whole groups of equal bins at a time; adds to ``open_bins``."""
    room: dict[int, Counter] = {}
    for pattern, n in open_bins:
        room.setdefault(size - fill(pattern), Counter())[pattern] += n
    spaces = sorted(room)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                old: Pattern = ()
                each = min(size // length, left)
                n = left // each
            else:
                space = spaces[at]
                old = next(iter(room[space]))
                each = min(space // length, left)
                n = min(room[space][old], left // each)
                room[space][old] -= n
                if not room[space][old]:
                    del room[space][old]
                    if not room[space]:
                        del room[space]
                        spaces.pop(at)
            merged = Counter(dict(old))
            merged[length] += each
            pattern = tuple(sorted(merged.items(), reverse=True))
            rest = size - fill(pattern)
            if rest not in room:
                room[rest] = Counter()
                insort(spaces, rest)
            room[rest][pattern] += n
            left -= n * each
    return sorted(((p, n) for v in room.values() for p, n in v.items()), reverse=True)


def bins_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def fitness(plan: Plan, size: int = SIZE) -> tuple[int, float]:
    """Fewer bins first; then bins of uneven fill, whose emptier half is easier to empty."""
    return -bins_of(plan), sum(n * (fill(p) / size) ** 2 for p, n in plan)


def least_bins(counts: dict[int, int], size: int = SIZE) -> int:
    """A number of bins that no plan can beat.

    For each length k up to half of ``size``: pieces over size - k stay alone, those over half of it have a bin each, and pieces from
    k to the half go into the room these leave, or into further bins.
    """
    if not counts:
        return 0
    w = np.array(sorted(counts), np.int64)
    c = np.array([counts[x] for x in w.tolist()], np.int64)
    n, total = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * w)))
    half = np.searchsorted(w, size // 2, side="right")
    k = np.concatenate(([0], w[:half]))
    alone, low = np.searchsorted(w, size - k, side="right"), np.searchsorted(w, k)
    wide = n[alone] - n[half]
    over = total[half] - total[low] - (wide * size - (total[alone] - total[half]))
    return int((n[-1] - n[half] + np.maximum(0, -(-over // size))).max())


def better_piece(pattern: Pattern, lengths: list[int], out: Counter, size: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """Pieces of a bin to take out and displaced ones to put in that fill it most: one or two for one, or one for two or one."""
    space = size - fill(pattern)
    best, chosen = 0, None
    ones = [((x,), x) for x, _ in pattern]
    twos = [((x, y), x + y) for i, (x, k) in enumerate(pattern) for y, _ in pattern[i:] if x != y or k > 1] if len(pattern) <= PAIRED else []
    for gone, taken in ones + twos:
        at = bisect_right(lengths, taken + space)
        if at and lengths[at - 1] - taken > best:
            best, chosen = lengths[at - 1] - taken, (gone, (lengths[at - 1],))
    for gone, taken in ones:
        i, j = 0, len(lengths) - 1
        while i <= j and best < space:
            gained = lengths[i] + lengths[j] - taken
            if gained > space:
                j -= 1
                continue
            if gained > best and (i != j or out[lengths[i]] > 1):
                best, chosen = gained, (gone, (lengths[i], lengths[j]))
            i += 1
    return chosen


def exchange(bins: Counter, out: Counter, size: int = SIZE) -> Counter:
    """``bins`` after displaced pieces (``out``, changed in place) took the place of smaller ones wherever a bin gets fuller."""
    lengths = sorted(out)
    done, todo = Counter(), list(bins.items())
    while todo:
        pattern, n = todo.pop()
        found = better_piece(pattern, lengths, out, size) if lengths and fill(pattern) < size else None
        if found is None:
            done[pattern] += n
            continue
        gone, put = Counter(found[0]), Counter(found[1])
        times = min([n, *(out[x] // k for x, k in put.items())])
        merged = Counter(dict(pattern))
        merged.subtract(gone)
        merged.update(put)
        for x, k in put.items():
            out[x] -= times * k
            if not out[x]:
                del out[x]
                lengths.pop(bisect_left(lengths, x))
        for x, k in gone.items():
            if x not in out:
                insort(lengths, x)
            out[x] += times * k
        todo.append((tuple(sorted(((x, k) for x, k in merged.items() if k), reverse=True)), times))
        if n > times:
            todo.append((pattern, n - times))
    return done


def put_back(kept: Plan, displaced: Counter, size: int) -> Plan:
    out, bins = Counter({x: k for x, k in displaced.items() if k}), Counter()
    for p, n in kept:
        bins[p] += n
    bins = exchange(bins, out, size)
    return best_fit(out, bins.items(), size)


def crossover(giver: Plan, taker: Plan, rnd: random.Random, size: int = SIZE) -> Plan:
    """Injects well-filled bins of ``giver`` into ``taker``; the number of each length stays as it is."""
    filled = sorted(giver, key=lambda x: size - fill(x[0]))
    cut = rnd.randint(1, max(1, len(filled)))
    injected = [(p, rnd.randint(1, n)) for p, n in filled[:cut] if rnd.random() < 0.7] or filled[:1]
    twice = Counter()
    for p, n in injected:
        for length, k in p:
            twice[length] += n * k
    kept, displaced = [], Counter()
    for p, n in sorted(taker, key=lambda x: (fill(x[0]), rnd.random())):
        hit = max((-(-twice[x] // k) for x, k in p if twice[x] > 0), default=0)
        out = min(n, hit)
        for x, k in p:
            use = min(twice[x], k * out)
            twice[x] -= use
            displaced[x] += k * out - use
        if n > out:
            kept.append((p, n - out))
    return put_back(kept + injected, displaced, size)


def mutate(plan: Plan, rnd: random.Random, size: int = SIZE) -> Plan:
    """Empties some bins, of those with room more, and puts their pieces back."""
    share = rnd.choice((0.02, 0.1, 0.3))
    kept, displaced = [], Counter()
    for p, n in plan:
        out = rnd.randint(1, n) if rnd.random() < (0.5 if fill(p) < size else share) else 0
        for x, k in p:
            displaced[x] += out * k
        if n > out:
            kept.append((p, n - out))
    rnd.shuffle(kept)
    return put_back(kept, displaced, size)


def evolve(population: list[Plan], floor: int, seed: int, size: int = SIZE) -> tuple[Plan, int]:
    """The fittest plan after an epoch that starts from ``population``, and how many children it made."""
    rnd, population = random.Random(seed), population[:]
    while len(population) < POPULATION:
        population.append(mutate(population[0], rnd, size))
    rank = lambda p: fitness(p, size)
    best, stale, made = max(population, key=rank), 0, 0
    while stale < STALE and bins_of(best) > floor:
        a, b = rnd.sample(population, 2)
        child = crossover(a, b, rnd, size)
        if rnd.random() < 0.4:
            child = mutate(child, rnd, size)
        made += 1
        worst = min(range(len(population)), key=lambda i: rank(population[i]))
        if len(child) <= MOST and rank(child) > rank(population[worst]) and child not in population:
            population[worst] = child
        fittest = max(population, key=rank)
        stale = 0 if bins_of(fittest) < bins_of(best) else stale + 1
        best = fittest
    return best, made


@dataclass
class Search:
    """The best plan, bins of best fit alone, bins that no plan can beat, and children that were made."""

    plan: Plan
    seed_bins: int
    least_bins: int
    children: int = 0

    @property
    def bins(self) -> int:
        return bins_of(self.plan)


def frozen(plan: Plan) -> bytes:
    return zlib.compress(json.dumps(plan).encode())


def thawed(state: bytes) -> Plan:
    return [(tuple(map(tuple, p)), n) for p, n in json.loads(zlib.decompress(state))]


def search(spark: SparkSession, counts: dict[int, int], islands: int = ISLANDS, size: int = SIZE) -> Search:
    """Each epoch is a Spark job with a task per island, which gets its own elite and that of the island before it."""
    hist = {int(k): int(v) for k, v in counts.items()}
    seed, floor = best_fit(hist, size=size), least_bins(hist, size)
    out = Search(seed, bins_of(seed), floor)
    elites, epoch = [seed] * islands, 0
    while out.bins > floor:

        def work(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for island, *states in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    best, made = evolve([thawed(x) for x in dict.fromkeys(states)], floor, 1000 * epoch + island, size)
                    yield pa.RecordBatch.from_arrays([pa.array([island], pa.int32()), pa.array([made], pa.int32()), pa.array([frozen(best)], pa.binary())], names=["island", "made", "elite"])

        rows = [(i, frozen(elites[i]), frozen(elites[i - 1])) for i in range(islands)]
        frame = spark.createDataFrame(rows, "island int, own binary, other binary").repartitionByRange(islands, "island")
        done = frame.mapInArrow(work, "island int, made int, elite binary").collect()
        elites = [thawed(r.elite) for r in sorted(done, key=lambda r: r.island)]
        best = max(elites, key=lambda p: fitness(p, size))
        saved = bins_of(best) < out.bins
        out = Search(best, out.seed_bins, floor, out.children + sum(r.made for r in done))
        epoch += 1
        if not saved:
            break
    return out


def slots(plan: Plan, first: int = 0) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, pieces a bin, offset of the first of them), by ascending rank."""
    out: dict[int, list] = defaultdict(list)
    at: Counter = Counter()
    for pattern, n in plan:
        offset = 0
        for length, k in pattern:
            out[length].append((at[length], first, k, offset))
            at[length] += n * k
            offset += length * k
        first += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in out.items()}


PIECES = "pid int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces, written to the shared folder. pid, nth: input partition, rank there within the length."""
    bound_batches(docs.sparkSession)
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen, coder, end = TaskContext.get().partitionId(), Counter(), encoder(tokenizer, "word"), np.array([END_ID], "<u4").tobytes()
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = coder.one(text.as_py() or "") + end
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    n = len(part) // 4
                    rows.append((pid, seen[n], doc_id, k, a // 4, n, zlib.crc32(part), *([part] if with_ids else [])))
                    seen[n] += 1
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return written(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, unless told not to, ids of every piece."""
    spark = docs.sparkSession
    table = pieces(docs, tokenizer, size, with_ids)
    tally = table.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tally = written(tally.select("pid", "length", "n", before.alias("before")), "piece-tally")
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(size, 0)
    where = slots(search(spark, counts, size=size).plan, full)
    where[size] = tuple(np.array([v], np.int64) for v in (0, 0, 1, 0))
    shared = spark.sparkContext.broadcast(where)
    ranked = table.join(tally.select("pid", "length", "before"), ["pid", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        encoder.cache_clear()  # a worker that tokenised has no more use for its pieces
        for b in batches:
            length, rank = b.column(keep.index("length")).to_numpy(), b.column(len(keep)).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                first, base, per, place = table[x]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                past = rank[rows] - first[k]
                seq[rows] = base[k] + past // per[k]
                off[rows] = place[k] + past % per[k] * x
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "rank").mapInArrow(deal, schema)
