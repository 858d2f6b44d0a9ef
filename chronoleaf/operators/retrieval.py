"""A vector index for retrieval by cosine: inverted lists over coarse centroids, with quantised residuals.

The centroids and the codebooks are fitted on a sample of at most SAMPLE rows (fewer for long vectors: SAMPLE_BYTES), drawn by
a hash of the key; every row is indexed. The index is Parquet: blocks of at most about BLOCK codes of one list, so a list that
holds most rows is many blocks in many files. A search sends each query to its nearest lists only, scores the codes there
by table lookups in blocks, and ranks the best candidates again by their exact vectors. How many lists that takes is measured on the
sample: as few as find TARGET of the true neighbours there. ``selection.nearest`` is the exact search.

Rows without a key or a vector, zero vectors and vectors of another length than the sample's most frequent one are not indexed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.operators.selection import cosine, top_k
from chronoleaf.operators.store import dropped, stored

SAMPLE, SAMPLE_BYTES, BLOCK, TARGET = 50_000, 64 << 20, 1024, 0.97
MOST_LISTS, CODES, QUERIES = 4096, 256, 256


@dataclass
class Model:
    """Centroids (lists x d), codebooks (parts x codes x d / parts), lists to look into."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def d(self) -> int:
        return self.centroids.shape[1]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds; a centre without rows moves to a random row."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest_centre(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c * c).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ c.T - half).argmax(axis=1)
    return out


def vectors_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    return df.filter(good).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def fit(items: DataFrame, key: str, vector: str, parts: int = 16, k: int = 5, seed: int = 0) -> Model:
    """The model of ``items``, from a sample of at most SAMPLE of its rows."""
    x = vectors_of(items, key, vector)
    n, length = x.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no vectors to fit")
    most = min(SAMPLE, max(1000, SAMPLE_BYTES // (8 * length)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40))
    sample = x.filter(draw < int((1 << 40) * min(1.0, most / n))).limit(2 * most) if n > most else x
    rows = sample.toArrow().column("v").to_pylist()
    d = Counter(map(len, rows)).most_common(1)[0][0]
    v = unit(np.array([r for r in rows if len(r) == d]))
    rng = np.random.default_rng(seed)
    lists = int(min(MOST_LISTS, max(1, round(n**0.5)), max(1, len(v) // 20)))
    centroids = k_means(v, lists, rng)
    width = -(-d // parts)
    rest = np.zeros((len(v), parts * width))
    rest[:, :d] = v - centroids[nearest_centre(v, centroids)]
    books = np.stack([k_means(rest[:, p * width : (p + 1) * width], min(CODES, len(v)), rng, 8) for p in range(parts)])
    return Model(centroids, books, probes_for(v, centroids, k, rng))


def probes_for(v: np.ndarray, centroids: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """The number of nearest lists in which TARGET of the k nearest sample rows of 200 sample rows lie."""
    at = nearest_centre(v, centroids)
    q = rng.choice(len(v), min(200, len(v)), replace=False)
    score = v[q] @ v.T
    score[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(v) - 1)]
    place = (-(v[q] @ centroids.T)).argsort(axis=1).argsort(axis=1)
    rank = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
    return int(rank[min(len(rank) - 1, int(TARGET * len(rank)))]) + 1 if len(rank) else 1


def build(items: DataFrame, key: str, vector: str, path: str, parts: int = 16, k: int = 5, seed: int = 0) -> Model:
    """Fits a model and writes the index of all rows of ``items``: model and blocks (list, block, ids, codes)."""
    spark, model = items.sparkSession, fit(items, key, vector, parts, k, seed)
    rows = [("centroid", i, c.tolist()) for i, c in enumerate(model.centroids)] + [(f"book {p}", i, c.tolist()) for p, b in enumerate(model.books) for i, c in enumerate(b)]
    spark.createDataFrame([*rows, ("probes", model.probes, [])], "kind string, number int, vector array<double>").coalesce(1).write.parquet(f"{path}/model")
    sent, d = spark.sparkContext.broadcast(model), model.d

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        parts, _, width = m.books.shape
        for b in batches:
            v = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)) if len(b) else np.zeros((0, d))
            at = nearest_centre(v, m.centroids)
            rest = np.zeros((len(v), parts * width))
            rest[:, :d] = v - m.centroids[at]
            codes = np.stack([nearest_centre(rest[:, p * width : (p + 1) * width], m.books[p]) for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    coded = stored(vectors_of(items, key, vector).filter(F.size("v") == d).mapInArrow(encode, "id long, list int, code binary"), "codes")
    blocks = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))  # at most MOST_LISTS rows
    x = coded.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    x = x.groupBy("list", "block").agg(F.collect_list(F.struct("id", "code")).alias("r"))
    x.select("list", "block", F.col("r.id").alias("ids"), F.col("r.code").alias("codes")).write.parquet(f"{path}/blocks")
    dropped(coded)
    return model


def load(spark: SparkSession, path: str) -> Model:
    rows = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: (r.kind, r.number))
    of = lambda kind: np.array([r.vector for r in rows if r.kind == kind])
    parts = sum(r.kind.startswith("book") and r.number == 0 for r in rows)
    return Model(of("centroid"), np.stack([of(f"book {p}") for p in range(parts)]), next(r.number for r in rows if r.kind == "probes"))


def search(queries: DataFrame, items: DataFrame, path: str, key: str, vector: str, k: int = 5, probes: int | None = None, deep: int = 20) -> DataFrame:
    """query, item, score, rank: of each query about the k items of greatest cosine but itself, from the index at ``path``.

    Of each block a query looks into, the k * deep best by code go on, of all its blocks the k * deep best, and these
    are ranked by their vectors in ``items``, with the scores and the order of ``selection.nearest``.
    """
    spark = queries.sparkSession
    model = load(spark, path)
    sent, d = spark.sparkContext.broadcast(model), model.d
    wide, look = k * deep, min(probes or model.probes, len(model.centroids))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
            lists = np.argsort(-(unit(v) @ m.centroids.T), axis=1)[:, :look].ravel() if len(b) else np.zeros(0)
            at = pa.array(np.repeat(np.arange(len(b)), look))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["list", "id", "v"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        parts, n_codes, width = m.books.shape
        for b in batches:
            for at, qid, qv, ids, codes in zip(*b.columns, strict=True):
                q, items_ = qid.values.to_numpy(), ids.values.to_numpy()
                v = unit(qv.values.to_numpy().reshape(len(q), d))
                padded = np.zeros((len(q), parts * width))
                padded[:, :d] = v
                tables = np.einsum("qpw,pcw->qpc", padded.reshape(len(q), parts, width), m.books)
                code = np.frombuffer(b"".join(codes.as_py()), dtype=np.uint8).reshape(len(items_), parts)
                score = (v @ m.centroids[at.as_py()])[:, None] + sum(tables[:, p][:, code[:, p]] for p in range(parts))
                # near by distance, as rows that are almost equal differ in direction by less than their codes do in length
                rest = np.concatenate([m.books[p][code[:, p]] for p in range(parts)], axis=1)[:, :d]
                score -= ((m.centroids[at.as_py()] + rest) ** 2).sum(axis=1) / 2
                score[q[:, None] == items_] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :wide]
                found = np.take_along_axis(score, top, axis=1).ravel()
                out = pa.RecordBatch.from_arrays([pa.array(np.repeat(q, top.shape[1])), pa.array(items_[top].ravel()), pa.array(found)], names=["query", "item", "score"])
                yield out.filter(pa.array(found > -np.inf))

    q = vectors_of(queries, key, vector).filter(F.size("v") == d)
    asked = q.mapInArrow(routes, "list int, id long, v array<double>")
    # queries of a list in groups of about QUERIES, so that a list that many ask for is many rows
    per = stored(asked, "routes")
    groups = per.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_groups"))
    asked = per.join(F.broadcast(groups), "list").withColumn("_g", F.pmod(F.xxhash64("id"), F.col("_groups")))
    asked = asked.groupBy("list", "_g").agg(F.collect_list(F.struct("id", "v")).alias("r")).select("list", F.col("r.id").alias("q_id"), F.flatten("r.v").alias("q_v"))
    met = asked.join(spark.read.parquet(f"{path}/blocks"), "list").select("list", "q_id", "q_v", "ids", "codes")
    rough = top_k(met.mapInArrow(best, "query long, item long, score double"), "query", "item", "score", wide).select("query", "item")
    exact = rough.join(q.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query").join(vectors_of(items, key, vector).select(F.col("id").alias("item"), F.col("v").alias("iv")), "item")
    return top_k(exact.select("query", "item", F.round(cosine(F.col("qv"), F.col("iv")), 9).alias("score")), "query", "item", "score", k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, pairs, recall: the share of the true (query, item) pairs that were found."""
    x = true.select("query", "item").join(found.select("query", "item", F.lit(1.0).alias("_f")), ["query", "item"], "left")
    return x.agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce("_f", F.lit(0.0))).alias("recall"))
