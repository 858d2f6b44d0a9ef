"""Splits, shuffles, top-k and preference selection. Draws are hashes, so a rerun repeats them on any cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.functions.answers import cache_key
from chronoleaf.operators.ranks import ranked


def draw(seed: int, *parts: Column) -> Column:
    """A hash that orders rows at random, the same in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def numeric_id(video_id: Column) -> Column:
    """All digits of an id as a number, 0 for none."""
    return F.coalesce(F.regexp_replace(video_id.cast("string"), r"\D", "").try_cast("long"), F.lit(0))


def shuffled_limit(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(seed, F.col(key).cast("string")), key).limit(n)


def grouped_split(ids: DataFrame, key: str, strata: str | None = None, ratios: tuple[float, float] = (0.6, 0.2), seed: int = 0) -> DataFrame:
    """Adds split: of each stratum in drawn order, round(n r) train, then val, the rest test. Ranked by ranges of the draw."""
    x = ranked(ids, [draw(seed, F.col(key).cast("string")), F.col(key)], by=[strata] if strata else [], rank="_k", count="_n")
    train, val = (F.bround(F.col("_n") * F.lit(r), 0) for r in ratios)
    split = F.when(F.col("_k") <= train, "train").when(F.col("_k") <= train + val, "val").otherwise("test")
    return x.withColumn("split", split).drop("_k", "_n")


def fixed_split(ids: DataFrame, key: str, scheme: str, counts: tuple[int, ...] = (), official: DataFrame | None = None, center: str = "center") -> DataFrame:
    """Adds split by a named scheme: twinanda_40_40 (counts: val out of train), official_10_4_7, by_video (counts as ratios), rdv, all_test
    or official_per_center: by a table ``official`` (key, split), null where that has none; without a table, .6, .15 and .25 of each center.
    """
    if scheme == "official_per_center":
        if official is None:
            return grouped_split(ids, key, center, (0.6, 0.15))
        return ids.join(official.select(F.col(key).alias("_k"), "split"), F.col(key) == F.col("_k"), "left").drop("_k")
    if scheme == "by_video":
        return grouped_split(ids, key, ratios=(counts[0] / sum(counts), counts[1] / sum(counts)))
    if scheme == "rdv":
        return grouped_split(ids, key)
    if scheme == "all_test":
        return ids.withColumn("split", F.lit("test"))
    if scheme not in ("twinanda_40_40", "official_10_4_7"):
        raise ValueError(f"unknown split scheme {scheme}")
    x, k = ranked(ids, [numeric_id(F.col(key)), F.col(key)], rank="_k"), F.col("_k")
    if scheme == "twinanda_40_40":
        val = counts[0] if counts else 8
        split = F.when(numeric_id(F.col(key)) > 40, "test").when(k <= val, "val").otherwise("train")
    else:
        split = F.when(k <= 10, "train").when(k <= 14, "val").when(k <= 21, "test")
    return x.withColumn("split", split).drop("_k")


def hashed_split(ids: DataFrame, key: str, parts: int = 5, seed: int = 0) -> DataFrame:
    """Adds split by a hash alone: one part test, one val, the rest train; no ranking, no shuffle."""
    h = F.pmod(F.conv(F.substring(draw(seed, F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    return ids.withColumn("split", F.when(h == 0, "test").when(h == 1, "val").otherwise("train"))


def videos_of(split: DataFrame, name: str) -> DataFrame:
    """The rows of one split; one without any raises."""
    out = split.filter(F.col("split") == name)
    if not out.limit(1).count():
        raise ValueError(f"split {name!r} is empty")
    return out


def split_leaks(split: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split."""
    return split.groupBy(key).agg(F.count_distinct("split").cast("long").alias("n_splits")).filter("n_splits > 1")


def center_leaks(split: DataFrame, center: str, a: str = "train", b: str = "test") -> DataFrame:
    """Centers that both splits have."""
    of = lambda s: split.filter((F.col("split") == s) & F.col(center).isNotNull()).select(center)
    return of(a).intersect(of(b))


def assert_empty(df: DataFrame, what: str) -> None:
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {bad}")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items of each query, ties by item."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, k: int, block: tuple[int, int] = (256, 2048), within: str | None = None) -> DataFrame:
    """query, item, score, rank: of each query the k items of greatest cosine among all items but itself, ties by item.

    Blocks of queries meet blocks of items in matrix products. A task holds one block of each and the k best items so far of
    its queries; what tasks leave is merged. Scores are rounded to 9 places before they are compared. Null and zero vectors
    meet nothing. ``within`` names a column whose values must be equal: blocks are cut inside each value, and null meets nothing.
    """

    def blocks(df: DataFrame, key: str, size: int, out: str) -> DataFrame:
        group = F.col(within) if within else F.lit(0)
        row = F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        x = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(group.alias("_w"), F.xxhash64(key).alias("_h"), row.alias("r")).filter("_w IS NOT NULL")
        parts = x.groupBy("_w").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
        x = x.join(parts, "_w").groupBy("_w", F.pmod("_h", "_n").alias("b")).agg(F.collect_list("r").alias(out))
        return x.select(F.col("_w").alias(f"_{out}_w"), F.col("b").alias(f"{out}_b"), F.col(f"{out}.id").alias(f"{out}_id"), F.flatten(f"{out}.v").alias(f"{out}_v"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(ids: pa.ListScalar, flat: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
            i = ids.values.to_numpy()
            v = flat.values.to_numpy().reshape(len(i), -1)
            n = np.sqrt((v * v).sum(axis=1))
            return i[n > 0], v[n > 0] / n[n > 0][:, None]

        def left() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(items), pa.array(scores)], names=["query", "item", "score"])

        # row, items, scores: the best so far of the block of queries at hand; least: what a row's next item must reach
        at = None
        for b in batches:
            for block, q_ids, q_flat, e_ids, e_flat in zip(*b.columns, strict=True):
                if block.as_py() != at:
                    if at is not None:
                        yield left()
                    at, (qi, qv) = block.as_py(), unit(q_ids, q_flat)
                    row, items, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(qi), -np.inf)
                ei, ev = unit(e_ids, e_flat)
                if not len(qi) or not len(ei):
                    continue
                score = qv @ ev.T
                bound = least
                if len(ei) > k and np.isinf(least).any():
                    score[qi[:, None] == ei] = -np.inf
                    bound = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
                r, c = np.nonzero(score >= (bound - 2e-9)[:, None])
                r, c = (x[qi[r] != ei[c]] for x in (r, c))
                row, items, scores = np.concatenate([row, r]), np.concatenate([items, ei[c]]), np.concatenate([scores, np.round(score[r, c], 9)])
                order = np.lexsort((items, -scores, row))
                row, items, scores = row[order], items[order], scores[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                least[row[place == k - 1]] = scores[place == k - 1]
                row, items, scores = (x[place < k] for x in (row, items, scores))
        if at is not None:
            yield left()

    # the blocks of queries are dealt out by number, as few bytes of them stand for many products
    q = blocks(queries, query, block[0], "q").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    e = blocks(items, item, block[1], "e")
    met = q.crossJoin(e) if within is None else q.join(e, F.col("_q_w") == F.col("_e_w"))
    block_of = F.concat_ws(":", F.col("_q_w").cast("string"), F.col("q_b").cast("string"))
    x = met.select(block_of.alias("b"), "q_id", "q_v", "e_id", "e_v").mapInArrow(best, "query long, item long, score double")
    return top_k(x, "query", "item", "score", k)


def top_fraction(scored: DataFrame, group: str, item: str, score: str, fraction: float = 0.25) -> DataFrame:
    """Of each group, the best ceil(n * fraction) items."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(F.desc(score), item))
    return scored.withColumn("rank", rank).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("rank") <= F.ceil(F.col("_n") * F.lit(fraction))).drop("_n")


def preference_pairs(scored: DataFrame, group: str, item: str, score: str, margin: float = 0.0) -> DataFrame:
    """group, chosen, rejected and their scores: best and worst of each group where they differ by over the margin."""
    x = scored.groupBy(group).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i"))).alias("b"), F.min(F.struct(F.col(score).alias("s"), F.col(item).alias("i"))).alias("w"))
    x = x.select(group, (-F.col("b.i")).alias("chosen"), F.col("w.i").alias("rejected"), F.col("b.s").alias("chosen_score"), F.col("w.s").alias("rejected_score"))
    return x.filter(F.col("chosen_score") - F.col("rejected_score") > margin)


def paraphrased(items: DataFrame, cache: DataFrame, key: str, question: str, order: str | None = None) -> DataFrame:
    """Replaces a question by its cached paraphrase; a miss or a blank keeps it. The last cache entry of a key counts."""
    pick = F.max_by("paraphrase", order) if order else F.max("paraphrase")
    one = cache.groupBy(F.col("key").alias("_k")).agg(pick.alias("_p"))
    return items.join(one, F.col(key) == F.col("_k"), "left").withColumn(question, F.coalesce(F.nullif(F.trim("_p"), F.lit("")), F.col(question))).drop("_k", "_p")


def paraphrase_requests(items: DataFrame, question: str, sub_type: str, model: str) -> DataFrame:
    """key, orig of the distinct questions that a paraphrase cache has to hold."""
    key = cache_key(F.col(question), F.col(sub_type), F.lit(model))
    return items.select(key.alias("key"), F.col(question).alias("orig")).groupBy("key").agg(F.min("orig").alias("orig"))


def keep_recent(files: DataFrame, size: str, at: str, item: str, cap: int) -> DataFrame:
    """Files to keep so that, newest first, their sizes stay within the cap: a least-recently-used eviction."""
    return ranked(files, [F.desc(at), F.col(item)], rank="_k", sums={"_s": size}).filter(F.col("_s") <= cap).drop("_k", "_s")
