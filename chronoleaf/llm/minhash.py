"""Near-duplicate documents by MinHash with tensored banding.

Two collections of small hashes are computed, each hash the join of WIDTH minhashes. A table is a pair of one hash
of either collection: h**2 tables of 2 * WIDTH minhashes each, from only 2 * h * WIDTH minhash functions. A pair of
similarity s shares no table with a probability of about 2 * (1 - s**WIDTH)**h. ``halves_for`` takes the h that holds
it at MISS at the threshold: 12 at 0.85, which op9 asks for, and 16 at 0.8, which the pipeline asks for.

Documents of equal shingle sets are one class, and only class representatives go on. Hashes that no other
representative has are dropped before they are paired. In each table's bucket the member that meets others
most often is the pivot, and every representative is first verified against its best pivot. In buckets that are not
one component by then, members are compared with all pivots there, and what sets them off from a pivot proves
most pairs apart (``feasible``); the rest are verified. So no link that a table shows is lost, while no bucket
is expanded to pairs. Verification compares the full shingle sets of whole texts.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a
shingle make one shingle; a null doc_id has a null component and is kept; rows that repeat a doc_id with different
texts count as one document; extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches, discard, written
from chronoleaf.llm.components import components

WIDTH, SEED, MISS = 3, 11, 2.2e-5
#: Members of a group that one task compares with all of the group.
TOGETHER = 2048
SIGNATURES = "doc_id long, n_shingles long, set_hash binary, keys array<bigint>"
GOLD = np.uint64(0x9E3779B97F4A7C15)


def halves_for(percent: int, width: int = WIDTH, miss: float = MISS) -> int:
    """Small hashes a collection, so that pairs at the threshold share a table but for a probability of ``miss``."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** width))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiplications and shifts that spread every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words, A-Z in lower case."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out * GOLD + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def functions(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n hash functions."""
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * GOLD + np.uint64(seed))
    return base[:n] | np.uint64(1), base[n:]


def minhashes(values: np.ndarray, multiply: np.ndarray, add: np.ndarray, step: int = 4096) -> np.ndarray:
    out = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), step):
        part = values[a : a + step]
        np.minimum(out, (part[None, :] * multiply[:, None] + add[:, None]).min(axis=1), out=out)
    return out


def half_keys(values: np.ndarray, multiply: np.ndarray, add: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One key per small hash of both collections: its place and its ``width`` minhashes."""
    m = minhashes(values, multiply, add).reshape(-1, width)
    key = np.arange(1, len(m) + 1, dtype=np.uint64) * GOLD
    for k in range(width):
        key = mix(key * GOLD + m[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, halves: int, width: int = WIDTH) -> DataFrame:
    """SIGNATURES of each row of ``docs``, written to the shared folder."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in SIGNATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply, add = functions(2 * halves * width)
        for big in batches:
            for a in range(0, big.num_rows, 1024):
                b = big.slice(a, 1024)
                sizes, hashes, keys = [], [], []
                for text in b.column(1):
                    s = shingles(text.as_py(), words)
                    sizes.append(len(s))
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    keys.append(half_keys(s, multiply, add, width) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    return written(docs.select("doc_id", "text").mapInArrow(run, SIGNATURES), "signatures")


def buckets(reps: DataFrame, halves: int) -> DataFrame:
    """reps (rep, n, keys) -> (bucket, rep, n, c): members of table buckets of c, two or more."""
    keys = reps.select("rep", "n", F.posexplode("keys").alias("slot", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("k"))
    met = keys.join(shared, F.col("key") == F.col("k"), "left_semi")
    sides = met.groupBy("rep", "n").agg(F.collect_list(F.when(F.col("slot") < halves, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("slot") >= halves, F.col("key"))).alias("b"))
    tables = sides.filter((F.size("a") > 0) & (F.size("b") > 0)).select("rep", "n", F.explode("a").alias("x"), "b").select("rep", "n", "x", F.explode("b").alias("y"))
    rows = tables.select(F.xxhash64("x", "y").alias("bucket"), "rep", "n")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumnRenamed("bucket", "t")
    return written(rows.join(counts, F.col("bucket") == F.col("t")).select("bucket", "rep", "n", "c"), "buckets")


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full shingle sets meet 100 * intersection >= percent * union."""
    x = pairs.join(texts.select(F.col("rep").alias("r"), F.col("text").alias("own")), F.col("u") == F.col("r")).select("u", "v", "own")
    x = x.join(texts.select(F.col("rep").alias("r"), F.col("text").alias("other")), F.col("v") == F.col("r")).select("u", "v", "own", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, np.uint64)
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                keep = []
                for own, other in zip(b.column(2), b.column(3), strict=True):
                    other = other.as_py()
                    if other != last:
                        last, pivot = other, shingles(other, words)
                    s = shingles(own.as_py(), words)
                    both = len(np.intersect1d(s, pivot, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(pivot) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return x.mapInArrow(compare, "u long, v long")


def linked(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, root) of every representative that is linked with another; None if there is none."""
    table = buckets(reps, halves_for(percent))
    met = written(table.groupBy("rep").agg(F.sum(F.col("c") - 1).alias("central")), "central", True)
    if not met.limit(1).count():
        return None
    texts = docs.select("doc_id", "text").join(met.select(F.col("rep").alias("r")), F.col("doc_id") == F.col("r"), "left_semi")
    texts = written(texts.select(F.col("doc_id").alias("rep"), "text"), "candidates")
    members = table.join(met.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("bucket", "rep", "n", "c", "central")
    members = written(members, "members")
    discard(table, met)
    best = members.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("rep")).alias("o"), "n")).alias("p"))
    best = written(best.select(F.col("bucket").alias("t"), (-F.col("p.o")).alias("pivot"), F.col("p.n").alias("pn"), F.col("p.central").alias("pc")), "pivots", True)
    first = members.join(best, F.col("bucket") == F.col("t")).filter((F.col("rep") != F.col("pivot")) & close_sizes(F.col("n"), F.col("pn"), percent))
    first = first.groupBy(F.col("rep").alias("u")).agg(F.max_by("pivot", F.struct("pc", -F.col("pivot"))).alias("v"))
    tested = written(first.select("u", "v"), "pairs")
    links = written(verified(tested, texts, words, percent), "verified")
    labels = written(components(links), "labels", True)
    x = members.select("bucket", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    labelled = written(x, "labelled", True)
    several = labelled.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select(F.col("bucket").alias("t"))
    mixed = written(labelled.join(several, F.col("bucket") == F.col("t"), "left_semi"), "mixed", True)
    discard(members, labelled)
    found = None
    if mixed.limit(1).count():
        pairs = written(feasible(mixed, best, tested, texts, words, percent), "pairs")
        found = written(verified(pairs, texts, words, percent), "verified")
        discard(pairs)
    if found is None or not found.limit(1).count():
        out = labels
    else:
        out = written(components(links.union(found)), "labels", True)
        discard(labels)
    discard(best, tested, links, mixed, texts, *([found] if found else []))
    return out


DELTAS = "rep long, p long, n long, d long, parts array<bigint>"


def deltas(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs (u, v) -> DELTAS: size of u's shingle set and the shingles that only one of u and v has."""
    x = pairs.join(texts.select(F.col("rep").alias("r"), F.col("text").alias("own")), F.col("u") == F.col("r")).select("u", "v", "own")
    x = x.join(texts.select(F.col("rep").alias("r"), F.col("text").alias("other")), F.col("v") == F.col("r")).select("u", "v", "own", "other")
    names = [c.split()[0] for c in DELTAS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, np.uint64)
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                sizes, parts = [], []
                for own, other in zip(b.column(2), b.column(3), strict=True):
                    other = other.as_py()
                    if other != last:
                        last, pivot = other, shingles(other, words)
                    s = shingles(own.as_py(), words)
                    sizes.append(len(s))
                    parts.append(np.setxor1d(s, pivot, assume_unique=True).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=names)

    return x.mapInArrow(run, DELTAS)


def feasible(mixed: DataFrame, best: DataFrame, tested: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of different components in a group of mixed buckets that may still be linked.

    A group is what mixed buckets connect; its pivot is its most central member. With d the shingles that only one of x and pivot p has, x and a differ in dx + da - 2 |Dx and Da| shingles,
    and what Dx and Da have in common can only be parts that several documents around p have, sx or sa at most.
    A link needs (100 + percent) * difference <= (100 - percent) * (nx + na). With E = (100 + percent) d -
    (100 - percent) n and H = 2 (100 + percent) s - E that leaves only pairs with Ea <= Hx and Ex <= Ha; all
    others are proved apart without being compared, and so are those with a common best pivot that fail there.
    So copies that differ from their centre in places of their own cost as much as there are of them.
    """
    up, down = 100 + percent, 100 - percent
    groups = components(mixed.join(best.select("t", "pivot"), F.col("bucket") == F.col("t")).select(F.col("rep").alias("u"), F.col("pivot").alias("v")))
    groups = written(groups.withColumnRenamed("node", "m"), "groups", True)
    central = best.groupBy("pivot").agg(F.max("pc").alias("pc")).join(groups, F.col("pivot") == F.col("m")).groupBy("root").agg(F.max(F.struct("pc", (-F.col("pivot")).alias("o"))).alias("top"))
    groups = groups.join(central.select(F.col("root").alias("gr"), (-F.col("top.o")).alias("g")), F.col("root") == F.col("gr")).select("m", "g")
    own = tested.select(F.col("u").alias("k"), F.col("v"))
    placed = mixed.select("rep", "root").distinct().join(groups, F.col("rep") == F.col("m")).join(own, F.col("rep") == F.col("k"), "left")
    placed = written(placed.select("rep", "root", "g", F.coalesce("v", "rep").alias("v")), "placed", True)
    near = written(placed.select(F.col("rep").alias("u"), F.col("g").alias("v")).union(placed.select("rep", "v")).distinct(), "near-pivots", True)
    table = written(deltas(near, texts, words), "deltas")
    parts = table.select("rep", "p", F.explode("parts").alias("part"))
    common = parts.groupBy(F.col("p").alias("q"), F.col("part").alias("c")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    s = parts.join(common, (F.col("p") == F.col("q")) & (F.col("part") == F.col("c"))).groupBy(F.col("rep").alias("sr"), F.col("p").alias("sp")).agg(F.count(F.lit(1)).alias("s"))
    x = table.select("rep", "p", "n", "d").join(s, (F.col("rep") == F.col("sr")) & (F.col("p") == F.col("sp")), "left")
    e = up * F.col("d") - down * F.col("n")
    x = written(x.select(F.col("rep").alias("k"), "p", "n", e.alias("e"), (2 * up * F.coalesce("s", F.lit(0)) - e).alias("h")), "bounds", True)
    by = lambda c: x.select(F.col("k").alias(f"{c}k"), F.col("p").alias(f"{c}p"), F.col("n").alias(f"{c}n"), F.col("e").alias(f"{c}e"), F.col("h").alias(f"{c}h"))
    y = placed.join(by("g"), (F.col("rep") == F.col("gk")) & (F.col("g") == F.col("gp"))).join(by("v"), (F.col("rep") == F.col("vk")) & (F.col("v") == F.col("vp")))
    y = written(y.select("rep", "root", "g", "v", F.col("gn").alias("n"), "ge", "gh", "ve", "vh"), "bounded", True)
    # what the other components of a group offer at best: the least E and the greatest H of another root
    best_of = y.groupBy("g").agg(F.min(F.struct("ge", "root")).alias("e1"), F.max(F.struct("gh", "root")).alias("h1")).withColumnRenamed("g", "bg")
    z = y.join(best_of, F.col("g") == F.col("bg"))
    second = z.groupBy(F.col("g").alias("cg")).agg(F.min(F.when(F.col("root") != F.col("e1.root"), F.col("ge"))).alias("e2"), F.max(F.when(F.col("root") != F.col("h1.root"), F.col("gh"))).alias("h2"))
    z = z.join(second, F.col("g") == F.col("cg"))
    least = F.when(F.col("root") != F.col("e1.root"), F.col("e1.ge")).otherwise(F.col("e2"))
    most = F.when(F.col("root") != F.col("h1.root"), F.col("h1.gh")).otherwise(F.col("h2"))
    y = written(z.filter((least <= F.col("gh")) & (F.col("ge") <= most)).select(*y.columns), "open", True)
    # a large group is dealt over tasks: each has some of the members and all of the others
    sizes = y.groupBy(F.col("g").alias("sg")).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("salts"))
    y = y.join(sizes, F.col("g") == F.col("sg")).drop("sg")
    z = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    y = y.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    z = z.select(*[F.col(c).alias(f"o_{c}") for c in z.columns])
    fits = (F.col("rep") < F.col("o_rep")) & (F.col("root") != F.col("o_root")) & close_sizes(F.col("n"), F.col("o_n"), percent)
    fits = fits & (F.col("o_ge") <= F.col("gh")) & (F.col("ge") <= F.col("o_gh"))
    fits = fits & ((F.col("v") != F.col("o_v")) | ((F.col("o_ve") <= F.col("vh")) & (F.col("ve") <= F.col("o_vh"))))
    pairs = y.join(z, (F.col("g") == F.col("o_g")) & (F.col("salt") == F.col("o_salt")) & fits).select(F.col("o_rep").alias("u"), F.col("rep").alias("v")).distinct()
    done = tested.select(F.greatest("u", "v").alias("tu"), F.least("u", "v").alias("tv"))
    return pairs.join(done, (F.col("u") == F.col("tu")) & (F.col("v") == F.col("tv")), "left_anti")


def classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows; set_hash -> component, one row per distinct shingle set)."""
    table = signatures(docs, words, halves_for(percent))
    full = table.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    own = written(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes", True)
    one = full.join(own.withColumnRenamed("set_hash", "s"), (F.col("set_hash") == F.col("s")) & (F.col("doc_id") == F.col("rep")))
    reps = written(one.select("rep", F.col("n_shingles").alias("n"), "keys", "set_hash").dropDuplicates(["rep", "set_hash"]).drop("set_hash"), "representatives")
    roots = linked(docs, reps, words, percent)
    if roots is None:
        return table, own.select("set_hash", F.col("rep").alias("component"))
    joined = own.join(roots, F.col("rep") == F.col("node"), "left").select("set_hash", F.coalesce("root", "rep").alias("component"))
    joined = written(joined, "class-components", True)
    discard(own, reps, roots)
    return table, joined


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``."""
    table, own = classes(docs, words, percent)
    x = table.select("doc_id", "n_shingles", "set_hash").join(own.withColumnRenamed("set_hash", "s"), F.col("set_hash") == F.col("s"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return x.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller doc_id; all columns."""
    gone = near_duplicates(docs, words, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(written(gone, "duplicates", True), "doc_id", "left_anti").select(*docs.columns)
