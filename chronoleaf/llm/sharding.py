"""Sharding by balanced label propagation: linked documents share a shard as far as equal sizes allow.

Documents are linked through hubs: a row (node, hub) says that a document belongs to a hub, and documents of one hub are
neighbours (equal texts have the hub of their hash). So links grow with the documents, not with pairs. Linked documents
start in a shard by hash. In each round, Spark joins count the members of every hub by shard and bring these counts back
to its documents; a document wishes to move to the shard where most of its neighbours are, ties by a hash of hub and
shard, so that neighbours agree. What the shards can take is a quota: wishes are summed by (from, to, class), the driver
solves at most 64 flows so that no shard exceeds its capacity, and a wish is granted if its class lies below the limit of
its flow. Classes put documents with few neighbours first, whose groups can be whole, and hashes split a class. Groups
that outgrow a shard fill it up and go on to the open shard where most of the rest is; small whole groups make room. When no wish is granted,
documents without neighbours, which cut no edge wherever they are, fill what each shard has left, by size class and hash.
Last, bins of documents that cut least are moved from the shards above the mean to those below, largest that fits
first, until the sizes differ by less than the smallest bin.

Scale: texts are read once and never shuffled; rounds move (id, size, counts) of linked documents only. Counts are
pre-aggregated. A hub that over 1 in 1,000 linked rows belong to is hot; there are at most 1,000 such, so their counts
are broadcast and no join has a hot key. The driver sees sums by (shard, shard, class), bounded by constants. Each round's
table is written, so a lost executor costs a read. Slots number the rows of a shard by blocks of equal hash.

Defined cases: a null text is an empty one (size 1) and shares its group; null ids and repeated rows are documents of
their own; an empty table gives no rows; other columns are ignored. If a group or a single document outgrows a shard,
or there are fewer documents than shards, sizes are as near as these allow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronoleaf.llm.common import discard, partitions, written

SHARDS = 8
#: Hashed bins of a class of wishes, and of a size class of movable documents.
BINS = 64
#: A hub with over this share of all linked rows is hot.
HOT = 0.001
#: Rounds end when twice less than this share of the linked bytes moved, or after ROUNDS.
STILL, ROUNDS = 0.0005, 14
#: Sizes count as even when the largest shard is within this of the mean.
EVEN = 0.0002


def bucket(key: Column, n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(n)).cast("int")


def log2_class(x: Column) -> Column:
    return F.floor(F.log2(F.greatest(x.cast("double"), F.lit(1.0)))).cast("int")


def flows(load: np.ndarray, want: np.ndarray, capacity: float) -> np.ndarray:
    """The part of each wanted flow (from, to) to grant, so that no shard ends above its capacity or its load now.

    Starts with all of them and scales down what flows into a shard that would exceed; as that keeps others from
    emptying, it repeats. Flows only fall, and none at all is feasible, so it settles.
    """
    x, most = want.astype(float).copy(), np.maximum(load, capacity)
    for _ in range(200):
        over = load + x.sum(axis=0) - x.sum(axis=1) - most
        if over.max() <= 1:
            break
        for j in np.flatnonzero(over > 0):
            into = x[:, j].sum()
            if into > 0:
                x[:, j] *= max(0.0, 1 - over[j] / into)
    return x


def limits(wishes: list, granted: np.ndarray) -> np.ndarray:
    """For each (from, to) the number of whole classes, in order, that the granted flow holds."""
    out = np.zeros(granted.shape, dtype=int)
    left = granted.copy()
    closed = np.zeros(granted.shape, dtype=bool)
    for w in sorted(wishes, key=lambda w: w.p):
        i, j = w.shard, w.to
        if closed[i, j]:
            continue
        if w.size <= left[i, j] + 1e-6:
            left[i, j] -= w.size
            out[i, j] = w.p + 1
        else:
            closed[i, j] = True
    return out


def literal(values: np.ndarray) -> Column:
    """A small array of whole numbers as a constant column."""
    return F.array(*[F.lit(int(v)) for v in values.ravel()])


def by_hub(members: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """members joined with a table of one row per hub; rows of hot hubs meet a broadcast of at most 1 / HOT rows."""
    h = hot.select(F.col("hub").alias("_h"))
    cold = members.join(F.broadcast(h), members["hub"] == F.col("_h"), "left_anti").join(table.join(F.broadcast(h), table["hub"] == F.col("_h"), "left_anti"), "hub")
    warm = members.join(F.broadcast(table.join(F.broadcast(h), table["hub"] == F.col("_h"), "left_semi")), "hub")
    return cold.withColumn("hot", F.lit(False)).unionByName(warm.withColumn("hot", F.lit(True)))


def tallies(members: DataFrame, n: int) -> DataFrame:
    """hub, t: the members of each hub by shard."""
    return members.groupBy("hub").agg(F.array(*[F.count_if(F.col("shard") == s) for s in range(n)]).alias("t"))


def wishes(members: DataFrame, hot: DataFrame, n: int, shut: np.ndarray, press: np.ndarray) -> DataFrame:
    """node, size, shard, near (neighbours), unit, to (shard wished for) and p (class of the wish) of each linked node.

    unit hashes what moves together: the least hub of a node, or the node itself if it has a hot hub. A node whose
    neighbours are all in a pressed shard wishes to leave it, to an open one by its unit, so that a larger group fits in.
    """
    seen = by_hub(members, tallies(members, n), hot)
    luck = [F.pmod(F.xxhash64("hub", F.lit(s)), F.lit(1 << 20)) / float(1 << 21) for s in range(n)]
    votes = [F.sum(F.col("t")[s] + luck[s]).alias(f"v{s}") for s in range(n)]
    all_of = F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a + v)
    apart = F.sum(all_of - F.get("t", "shard")).alias("apart")
    unit = F.when(F.bool_or("hot"), F.col("node")).otherwise(F.min(F.xxhash64("hub"))).alias("unit")
    x = seen.groupBy("node").agg(F.first("size").alias("size"), F.first("shard").alias("shard"), F.sum(all_of - 1).alias("near"), apart, F.bool_or("hot").alias("hot"), unit, *votes)
    offers = [F.struct(F.when(F.lit(bool(shut[s])) & (F.col("shard") != s), -1.0).otherwise(F.col(f"v{s}")).alias("v"), F.lit(s).alias("s")) for s in range(n)]
    to, free = F.greatest(*offers)["s"], np.flatnonzero(~shut)
    if press.any() and len(free):
        leaves = F.get(literal(press), "shard").cast("boolean") & ~F.col("hot") & (F.col("apart") == 0)
        to = F.when(leaves, F.get(literal(free), bucket(F.col("unit"), len(free), 29))).otherwise(to)
    x = x.withColumn("to", to.cast("int"))
    return x.select("node", "size", "shard", "near", "unit", "to", (log2_class(F.col("near") + 1) * BINS + bucket(F.col("unit"), BINS, 5)).alias("p"))


def propagate(nodes: DataFrame, links: DataFrame, n: int, capacity: float) -> DataFrame:
    """nodes (node, size, shard) and links (node, hub) -> node, size, shard, near, unit after label propagation, written."""
    total = links.count()
    hot = written(links.groupBy("hub").count().filter(F.col("count") > HOT * total).select("hub"), "hot-hubs", True)
    state, still = nodes, 0
    unmet, load = np.zeros(n), np.zeros(n)
    for turn in range(ROUNDS):
        # most rounds only offer shards with room, so that what a full one can't take gathers elsewhere
        masked = turn > 1 and turn % 4 > 0
        shut = masked & ((load > 0.95 * capacity) | (unmet > 0.01 * capacity))
        press = shut & (unmet > 0.01 * capacity)
        w = written(wishes(links.join(state.select("node", "size", "shard"), "node"), hot, n, shut, press), "wishes")
        sums = w.groupBy("shard", "to", F.when(F.col("shard") == F.col("to"), 0).otherwise(F.col("p")).alias("p")).agg(F.sum("size").alias("size")).collect()
        load, want = np.zeros(n), np.zeros((n, n))
        for r in sums:
            load[r.shard] += r.size
            if r.shard != r.to:
                want[r.shard, r.to] += r.size
        asked = want.copy()
        for s in np.flatnonzero(press & (want.sum(axis=1) > unmet)):
            asked[s] *= unmet[s] / want[s].sum()  # no more leaves than what wants in
        moving = [r for r in sums if r.shard != r.to]
        most = limits(moving, flows(load, asked, capacity))
        got = np.zeros((n, n))
        for r in moving:
            if r.p < most[r.shard, r.to]:
                got[r.shard, r.to] += r.size
        load += got.sum(axis=0) - got.sum(axis=1)
        unmet = (want - got).sum(axis=0)
        granted = F.col("p") < F.get(literal(most), F.col("shard") * n + F.col("to"))
        before, state = state, w.withColumn("shard", F.when(granted, F.col("to")).otherwise(F.col("shard"))).drop("to", "p")
        state.written_path = w.written_path
        if turn:
            discard(before)
        still = still + 1 if got.sum() <= STILL * max(1.0, load.sum()) else 0
        if not want.sum() or still == 2:
            break
    discard(hot)
    return state


def moves(bins: list, load: np.ndarray, tolerance: float) -> list[tuple[int, int, int, int]]:
    """(shard, class, bin, to): bins to move so that loads near their mean, least cut and largest that fits first."""
    load, mean, out = load.copy(), load.mean(), []
    for r in sorted(bins, key=lambda r: (r.cut, -r.size, r.shard, r.k, r.bin)):
        to = int(load.argmin())
        over, under = load[r.shard] - mean, mean - load[to]
        if r.size and min(over, under) > tolerance and r.size <= min(over, under) + tolerance:
            load[r.shard] -= r.size
            load[to] += r.size
            out.append((r.shard, r.k, r.bin, to))
    return out


def evened(placed: DataFrame, n: int, rounds: int = 3) -> DataFrame:
    """placed (node, size, shard, near, unit, ...) with shards of nearly equal sizes; documents without neighbours move first."""
    spark, written_now = placed.sparkSession, placed
    for turn in range(rounds):
        k = log2_class(F.col("near") + 1) * 64 + log2_class(F.col("size"))
        x = written_now.withColumns({"_k": k, "_bin": bucket(F.col("unit"), BINS, 11 + turn)})
        per = x.groupBy("shard").agg(F.sum("size").alias("size")).collect()
        load = np.zeros(n)
        for r in per:
            load[r.shard] = r.size
        if not load.sum() or load.max() - load.mean() <= EVEN * load.mean() and load.mean() - load.min() <= EVEN * load.mean():
            break
        over = [int(s) for s in np.flatnonzero(load > load.mean())]
        bins = x.filter(F.col("shard").isin(over)).groupBy("shard", F.col("_k").alias("k"), F.col("_bin").alias("bin")).agg(F.sum("size").alias("size"), F.max((F.col("near") > 0).cast("int")).alias("any"))
        found = [Bin(r.shard, r.k, r.bin, r.size, r.k // 64) for r in bins.collect()]
        plan = moves([b for b in found if not b.cut or turn], load, EVEN * load.mean() / 2)
        if not plan:
            continue
        table = spark.createDataFrame(plan, "m_shard int, m_k int, m_bin int, m_to int")
        same = (F.col("shard") == F.col("m_shard")) & (F.col("_k") == F.col("m_k")) & (F.col("_bin") == F.col("m_bin"))
        after = x.join(F.broadcast(table), same, "left").withColumn("shard", F.coalesce("m_to", "shard")).select(*placed.columns)
        after = written(after, "evened")
        discard(written_now)
        written_now = after
    return written_now


class Bin:
    def __init__(self, shard: int, k: int, number: int, size: int, cut: int):
        self.shard, self.k, self.bin, self.size, self.cut = shard, k, number, size, cut


def slots(placed: DataFrame) -> DataFrame:
    """Adds slot: the rows of each shard numbered from 0, by blocks of equal hash whose counts are added up before."""
    n = 4 * partitions(placed.sparkSession)
    x = placed.withColumn("_block", bucket(F.col("node"), n, 23))
    per = x.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(F.col("shard").alias("_s"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    x = x.join(per, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("node"))
    return x.withColumn("slot", F.col("_before") + place - 1).drop("_s", "_b", "_block", "_before")


def assign(nodes: DataFrame, links: DataFrame, n: int = SHARDS) -> DataFrame:
    """nodes (node: long, unique; size: long; other columns) and links (node, hub) -> nodes with near, shard and slot.

    A link names an existing node. Links may repeat; a node may have many hubs.
    """
    links = links.dropDuplicates(["node", "hub"])
    shared = links.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    hot = shared.filter(F.col("_n") > HOT * F.lit(max(1, links.count()))).select("hub")
    links = written(by_hub(links, shared, written(hot, "hot-links", True)).select("node", "hub"), "links")
    total = nodes.agg(F.sum("size")).first()[0] or 0
    capacity = total / n
    linked = written(nodes.join(links.select("node").distinct(), "node", "left_semi").select("node", "size", bucket(F.col("node"), n, 3).alias("shard")), "linked")
    placed = propagate(linked, links, n, capacity)
    load = np.zeros(n)
    for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        load[r.shard] = r.size
    room = np.maximum(capacity - load, 0)
    upper = np.cumsum(room) / room.sum() if room.sum() else np.arange(1, n + 1) / n
    u = F.pmod(F.xxhash64(F.lit(17), F.col("node")), F.lit(1 << 40)) / float(1 << 40)
    free = F.lit(n - 1)
    for s in reversed(range(n - 1)):
        free = F.when(u < float(upper[s]), s).otherwise(free)
    out = nodes.join(placed.select("node", F.col("shard").alias("_to"), F.col("near").alias("_near"), "unit"), "node", "left")
    out = out.withColumns({"near": F.coalesce("_near", F.lit(0)), "shard": F.coalesce("_to", free).cast("int"), "unit": F.coalesce("unit", "node")}).drop("_to", "_near")
    out = written(out, "placed")
    discard(placed, linked, links)
    return slots(evened(out, n))


def shard_documents(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and near (documents with an equal text) of each row."""
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"))
    x = written(x.withColumn("node", F.monotonically_increasing_id()), "documents-sizes")
    out = assign(x.drop("hub"), x.select("node", "hub"), n)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "near")
