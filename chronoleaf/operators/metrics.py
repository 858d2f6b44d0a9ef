"""Evaluation metrics as DataFrame plans. An undefined metric is null; NaN never comes out."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.functions import text as tx
from chronoleaf.functions.intervals import best_iou, center_distance, greedy_matches, hull_iou, length_bucket, mean_best_iou
from chronoleaf.operators.ranks import ranked

TOTAL = "overall"


# grounding


def grounding_scores(records: DataFrame, thresholds: Sequence[float] = (0.3, 0.5, 0.7), ks: Sequence[int] = (1, 5)) -> DataFrame:
    """records (pred_spans, gt_spans, duration_s) with len_bucket, iou (of the first prediction) and hit columns."""
    out = records.withColumn("len_bucket", length_bucket(F.col("duration_s"))).withColumn("iou", mean_best_iou(F.slice("pred_spans", 1, 1), F.col("gt_spans")))
    ious = F.transform("pred_spans", lambda p: best_iou(p, F.col("gt_spans")))
    out = out.withColumn("_ious", ious)
    for k in ks:
        for t in thresholds:
            out = out.withColumn(f"r{k}_{int(t * 100)}", F.coalesce(F.array_max(F.slice("_ious", 1, k)) >= t, F.lit(False)).cast("double"))
    return out.drop("_ious")


def grounding_report(records: DataFrame, thresholds: Sequence[float] = (0.3, 0.5, 0.7), ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Recall and mean IoU per length bucket and overall, by one rollup."""
    x = grounding_scores(records, thresholds, ks)
    hits = [F.avg(f"r{k}_{int(t * 100)}").alias(f"r{k}_{int(t * 100)}") for k in ks for t in thresholds]
    out = x.rollup("len_bucket").agg(F.grouping("len_bucket").alias("_g"), *hits, F.avg("iou").alias("miou"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("len_bucket", F.when(F.col("_g") == 1, TOTAL).otherwise(F.col("len_bucket"))).drop("_g")


#: Groups whose resampled sums a task holds at a time; draws it makes at a time; the prime that draws are taken modulo.
HELD, DRAWS, PRIME = 1024, 1 << 20, 268_435_399


def bootstrap_interval(records: DataFrame, value: str, unit: str, n: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """by, lo, hi: 2.5 and 97.5 percentiles of the mean of ``value`` over n resamples of units, per group of ``by``.

    A unit is drawn a Poisson(1) number of times in resample r, by u = ((a + b r + c r**2) mod PRIME) / PRIME, where a, b and c
    are 28 bits each of one md5 of seed and unit. So units are independent, resamples pairwise so, draws need no exchange
    and a rerun repeats them. ``unit`` is a record id, or a video id to resample videos. Values are summed per unit first. A
    task adds its units' draws to two vectors of n sums for each group, by matrix products, so rows never multiply by n:
    what is shuffled is n sums for each task and group.
    """
    per = records.filter(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.sum(value).cast("double").alias("_s"), F.count(F.lit(1)).cast("double").alias("_c"))
    hashed = F.md5(F.concat_ws(":", F.lit(f"draw:{seed}"), F.col(unit).cast("string")))
    bits = [F.conv(F.substring(hashed, 1 + 7 * i, 7), 16, 10).cast("long").alias(f"_h{i}") for i in range(3)]
    per = per.select(F.struct(*by).alias("_by") if by else F.lit(0).alias("_by"), "_s", "_c", *bits)
    cuts, p = [], 0.36787944117144233
    for k in range(1, 9):
        cuts.append(cuts[-1] + p if cuts else p)
        p /= k
    kind = per.schema["_by"].dataType.simpleString()

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        r = np.arange(n, dtype=np.int64)
        arrow = None

        def out() -> pa.RecordBatch:
            sums = [pa.array([s[k] for _, s in held.values()], pa.list_(pa.float64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in held.values()], arrow), *sums], names=["_by", "_rs", "_rc"])

        for b in batches:
            groups, arrow = b.column(0).to_pylist(), b.column(0).type
            keys = [tuple(g.values()) if isinstance(g, dict) else g for g in groups]
            place: dict = {}
            code = np.array([place.setdefault(k, len(place)) for k in keys], dtype=np.int64)
            sums = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()])
            h = [b.column(3 + i).to_numpy()[:, None] for i in range(3)]
            first = {k: groups[i] for i, k in reversed(list(enumerate(keys)))}
            for k, at in place.items():
                rows = np.flatnonzero(code == at) if len(place) > 1 else np.arange(len(keys))
                _, total = held.setdefault(k, (first[k], np.zeros((2, n))))
                for some in np.array_split(rows, max(1, len(rows) * n // DRAWS)):
                    u = (h[0][some] + h[1][some] * r + h[2][some] * (r * r)) % PRIME / PRIME
                    total += sums[:, some] @ np.searchsorted(cuts, u, side="right").astype(np.float64)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    x = per.mapInArrow(resample, f"_by {kind}, _rs array<double>, _rc array<double>")
    each = x.select("_by", F.posexplode(F.arrays_zip("_rs", "_rc")).alias("_rep", "_x"))
    means = each.groupBy("_by", "_rep").agg(F.try_divide(F.sum("_x._rs"), F.sum("_x._rc")).alias("_m"))
    out = means.groupBy("_by").agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))
    return out.select(*[F.col(f"_by.{c}").alias(c) for c in by], "lo", "hi")


def bootstrap_interval_independent(records: DataFrame, value: str, unit: str, n: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """by, lo, hi: 2.5 and 97.5 percentiles of the mean of ``value`` over n resamples of units, per group of ``by``.

    A unit is drawn a Poisson(1) number of times in each resample, by the first 40 bits of an md5 of (seed, resample, unit), so
    draws are independent over units and over resamples, and a rerun repeats them. ``unit`` is a record id, or a video id to
    resample videos. Values are summed per unit first; the n sums of a task combine before the shuffle. Digests are compared as
    text: hexadecimal digits of equal case stand in the order of their numbers.
    """
    # dealt out by number: few bytes of units stand for n draws each, and small partitions would be merged into one task
    own = records.filter(F.col(value).isNotNull()).select(*by, unit, value).repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, unit)
    per = own.groupBy(*by, unit).agg(F.sum(value).cast("double").alias("_s"), F.count(F.lit(1)).cast("double").alias("_c"))
    x = per.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = x.withColumn("_h", F.md5(F.concat_ws(":", F.lit(f"draw:{seed}"), F.col("_rep").cast("string"), F.col(unit).cast("string"))))
    draws, total, p = None, 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        below = F.col("_h") < f"{math.ceil(total * (1 << 40)):010x}"
        draws = F.when(below, float(k)) if draws is None else draws.when(below, float(k))
        p /= k + 1
    x = x.withColumn("_w", draws.otherwise(8.0))
    means = x.groupBy(*by, "_rep").agg(F.try_divide(F.sum(F.col("_s") * F.col("_w")), F.sum(F.col("_c") * F.col("_w"))).alias("_m"))
    return means.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))


# segmentation


def frame_accuracy(dense: DataFrame, keys: list[str], pred: str = "pred", gt: str = "gt", background: str | None = None) -> DataFrame:
    """Share of frames with the true label, over frames that have one."""
    known = F.col(gt).isNotNull() if background is None else F.col(gt) != background
    return dense.filter(known).groupBy(*keys).agg(F.avg(F.col(pred).eqNullSafe(F.col(gt)).cast("double")).alias("frame_acc"))


def edit_distance(a: Sequence[int], b: Sequence[int]) -> int:
    """Levenshtein distance of two sequences of whole numbers, a row of the table at a time as the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for y in b:
        same = masks.get(y, 0) | down
        diagonal = (((same & up) + up) ^ up) | same
        gain, loss = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(gain & top) - bool(loss & top)
        gain, loss = (gain << 1 | 1) & full, loss << 1 & full
        up, down = loss | ~(diagonal | gain) & full, gain & diagonal
    return distance


def edit_score(runs: DataFrame, keys: list[str], pred: str, gt: str) -> DataFrame:
    """Levenshtein distance of two run label sequences as a score of 0 to 100.

    runs: keys, side (pred or gt), run_id, code: any whole numbers, one for each label, background included. Spark's
    levenshtein compares strings, whose characters run out, so sequences are compared as numbers in Arrow batches.
    """
    codes = F.transform(F.array_sort(F.collect_list(F.struct("run_id", "code"))), lambda r: r["code"].cast("long"))
    x = runs.groupBy(*keys).pivot("side", [pred, gt]).agg(codes)
    empty = F.array().cast("array<bigint>")
    x = x.select(*keys, F.coalesce(pred, empty).alias("_p"), F.coalesce(gt, empty).alias("_g"))
    kinds = ", ".join(f"`{k}` {dict(x.dtypes)[k]}" for k in keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, p, g = b.columns
            found = [100.0 if not u and not v else (1 - edit_distance(u, v) / max(len(u), len(v))) * 100 for u, v in zip(p.to_pylist(), g.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.float64())], names=[*keys, "edit"])

    return x.mapInArrow(score, f"{kinds}, edit double")


def segmental_counts_at(pred: DataFrame, gt: DataFrame, keys: list[str], overlaps: Sequence[float]) -> DataFrame:
    """keys, np, ng (segments of either side) and tp_0, tp_1, ... of each overlap, from one join of predictions with truth.

    Each prediction claims its best true segment of the same label, and a segment counts once.
    """
    p = pred.select(*keys, "label", F.col("run_id").alias("p"), F.col("t0").alias("p0"), F.col("t1").alias("p1"))
    g = gt.select(*keys, "label", F.col("run_id").alias("g"), F.col("t0").alias("g0"), F.col("t1").alias("g1"))
    pairs = p.join(g, [*keys, "label"]).withColumn("iou", hull_iou(F.col("p0"), F.col("p1"), F.col("g0"), F.col("g1"))).filter("iou > 0")
    best = pairs.groupBy(*keys, "p").agg(F.max(F.struct("iou", (-F.col("g")).alias("o"))).alias("b"))
    hits = best.groupBy(*keys).agg(*[F.size(F.collect_set(F.when(F.col("b.iou") >= o, F.col("b.o")))).alias(f"tp_{i}") for i, o in enumerate(overlaps)])
    sides = pred.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_g")).union(gt.select(*keys, F.lit(0), F.lit(1)))
    n = sides.groupBy(*keys).agg(F.sum("_p").alias("np"), F.sum("_g").alias("ng")).join(hits, keys, "left")
    return n.select(*keys, "np", "ng", *[F.coalesce(F.col(f"tp_{i}"), F.lit(0)).cast("long").alias(f"tp_{i}") for i in range(len(overlaps))])


def segmental_counts(pred: DataFrame, gt: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    """tp, fp, fn per key."""
    n = segmental_counts_at(pred, gt, keys, [overlap])
    return n.select(*keys, F.col("tp_0").alias("tp"), (F.col("np") - F.col("tp_0")).alias("fp"), (F.col("ng") - F.col("tp_0")).alias("fn"))


def segmental_f1s(pred: DataFrame, gt: DataFrame, keys: list[str], overlaps: Sequence[float]) -> DataFrame:
    """keys and f1_0, f1_1, ... of each overlap, 0 to 100."""
    n = segmental_counts_at(pred, gt, keys, overlaps)
    return n.select(*keys, *[F.coalesce(F.try_divide(200.0 * F.col(f"tp_{i}"), F.col("np") + F.col("ng")), F.lit(0.0)).alias(f"f1_{i}") for i in range(len(overlaps))])


def segmental_f1(pred: DataFrame, gt: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    return segmental_f1s(pred, gt, keys, [overlap]).withColumnRenamed("f1_0", "f1")


# remaining duration


def minutes_bucket(m: Column, edges: Sequence[float] = (15, 30, 60)) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (m >= e).cast("int")
    return out


def duration_report(records: DataFrame) -> DataFrame:
    """records (pred_min, gt_min): mae_min, within5, within10, bucket_acc, n."""
    e = F.abs(F.col("pred_min") - F.col("gt_min"))
    within = lambda k: F.avg((e <= k).cast("double")).alias(f"within{k}")
    same = (minutes_bucket(F.col("pred_min")) == minutes_bucket(F.col("gt_min"))).cast("double")
    return records.agg(F.avg(e).alias("mae_min"), within(5), within(10), F.avg(same).alias("bucket_acc"), F.count(F.lit(1)).alias("n"))


def duration_by_decile(records: DataFrame) -> DataFrame:
    """decile 0 to 9 of elapsed_frac, mae_min (null where empty), n."""
    decile = F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.col("elapsed_frac") * 10).cast("int")))
    x = records.groupBy(decile.alias("decile")).agg(F.avg(F.abs(F.col("pred_min") - F.col("gt_min"))).alias("mae_min"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(10).select(F.col("id").cast("int").alias("decile"))
    return every.join(x, "decile", "left").select("decile", "mae_min", F.coalesce("n", F.lit(0)).alias("n"))


# detection


def average_precision(scored: DataFrame, cls: str = "cls", score: str = "score", label: str = "label") -> DataFrame:
    """ap per class that has positives and negatives: sum of recall steps times precision, ties taken together."""
    ties = scored.groupBy(cls, score).agg(F.sum(label).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cls).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(cls)
    x = ties.select(cls, "tp", F.sum("tp").over(w).alias("ctp"), F.sum("n").over(w).alias("cn"), F.sum("tp").over(every).alias("pos"), F.sum("n").over(every).alias("all"))
    return x.filter("pos > 0 and pos < all").groupBy(cls).agg(F.sum(F.col("tp") / F.col("pos") * F.col("ctp") / F.col("cn")).alias("ap"))


def class_f1(scored: DataFrame, threshold: float = 0.5, cls: str = "cls", score: str = "score", label: str = "label") -> DataFrame:
    """cls, f1 at the threshold; null for a class that is neither there nor predicted."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.count_if(c)
    x = scored.groupBy(cls).agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    return x.select(cls, F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def macro_f1(scored: DataFrame, threshold: float = 0.5, cls: str = "cls", score: str = "score", label: str = "label") -> DataFrame:
    return class_f1(scored, threshold, cls, score, label).agg(F.avg("f1").alias("macro_f1"))


def label_set(labels: Column) -> Column:
    return F.array_distinct(F.transform(labels, lambda x: F.lower(F.trim(x))))


def set_report(records: DataFrame, pred: str = "pred_labels", gt: str = "gt_labels") -> DataFrame:
    """Micro and macro precision, recall, F1 and mean Jaccard of label sets per record."""
    p, g = label_set(F.col(pred)), label_set(F.col(gt))
    x = records.select(F.size(F.array_intersect(p, g)).alias("tp"), F.size(p).alias("np"), F.size(g).alias("ng"), F.size(F.array_union(p, g)).alias("u"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, np_, ng = (F.col(c).cast("double") for c in ("tp", "np", "ng"))
    return x.agg(
        zero(F.sum(tp), F.sum(np_)).alias("micro_p"),
        zero(F.sum(tp), F.sum(ng)).alias("micro_r"),
        zero(2 * F.sum(tp), F.sum(np_) + F.sum(ng)).alias("micro_f1"),
        F.avg(zero(tp, np_)).alias("macro_p"),
        F.avg(zero(tp, ng)).alias("macro_r"),
        F.avg(zero(2 * tp, np_ + ng)).alias("macro_f1"),
        F.avg(F.when(F.col("u") == 0, 1.0).otherwise(tp / F.col("u"))).alias("jaccard"),
        F.count(F.lit(1)).alias("n"),
    )


# question answering


def qa_report(records: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return records.agg(F.avg(tx.exact_match(F.col(pred), F.col(gold))).alias("em"), F.avg(tx.token_f1(F.col(pred), F.col(gold))).alias("f1"), F.count(F.lit(1)).alias("n"))


def qa_pairs(records: DataFrame) -> DataFrame:
    """Adds pred and gold from the first alias that a record has."""
    has = lambda *names: [F.col(c) for c in names if c in records.columns]
    return records.withColumn("_p", F.coalesce(*has("pred", "pred_text"))).withColumn("_g", F.coalesce(*has("gold", "answer", "gold_text"))).drop("pred", "gold").withColumnsRenamed({"_p": "pred", "_g": "gold"})


def judge_report(records: DataFrame, verdict: str = "verdict", words: tuple = tx.VERDICTS) -> DataFrame:
    v = tx.verdict(F.col(verdict), words)
    share = lambda *w: F.avg(v.isin(*w).cast("double"))
    return records.agg(F.avg(tx.verdict_score(F.col(verdict), words)).alias("judge"), share("correct").alias("correct"), share("partial").alias("partial"), share("wrong", "incorrect").alias("wrong"), F.count(F.lit(1)).alias("n"))


def verdict_shares(records: DataFrame, keys: list[str], words: tuple = tx.VERDICTS, default: str = "wrong", verdict: str = "verdict") -> DataFrame:
    """keys, verdict, n, share of the key's records, and judge, the mean score of the key."""
    v, score = tx.verdict(F.col(verdict), words, default), tx.verdict_score(F.col(verdict), words, default)
    per = records.select(*keys, v.alias("verdict"), score.alias("_s")).groupBy(*keys, "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("_s"))
    every = Window.partitionBy(*keys)
    total = F.sum("n").over(every)
    return per.select(*keys, "verdict", "n", (F.col("n") / total).alias("share"), (F.sum("_s").over(every) / total).alias("judge"))


# calibration


def calibration_bins(records: DataFrame, conf: str = "conf", correct: str = "correct", n_bins: int = 15) -> DataFrame:
    """bin from 0, conf and acc means (null where empty), n. Bins are left-closed, 1.0 is in the last."""
    b = F.least(F.width_bucket(F.col(conf), F.lit(0.0), F.lit(1.0), F.lit(n_bins)), F.lit(n_bins)) - 1
    x = records.groupBy(F.greatest(b, F.lit(0)).cast("int").alias("bin")).agg(F.avg(conf).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(x, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.filter("n > 0").agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def adaptive_bins(records: DataFrame, order: str, conf: str = "conf", correct: str = "correct", n_bins: int = 15) -> DataFrame:
    """Equal-count bins by confidence; ``order`` breaks ties. Rows are ranked by ranges of both, so one confidence spreads too."""
    x = ranked(records.select(conf, correct, order), [F.col(conf), F.col(order)], rank="_k", count="_n")
    rank = F.col("_k") - 1
    size, extra = F.floor(F.col("_n") / n_bins), F.col("_n") % n_bins
    first = extra * (size + 1)
    b = F.when(rank < first, F.floor(rank / (size + 1))).otherwise(extra + F.floor(F.try_divide(rank - first, size)))
    x = x.withColumn("bin", b.cast("int"))
    return x.groupBy("bin").agg(F.avg(conf).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))


def temperature(records: DataFrame, logit: str = "logit", correct: str = "correct", rounds: int = 4, points: int = 33) -> float | None:
    """T that minimises the mean negative log likelihood of sigmoid(logit / T), log T in [-4, 4].

    A grid over log T is summed in one aggregation and narrowed around its best point, ``rounds`` times; the
    driver sees one row a round.
    """
    low, high = -4.0, 4.0
    best = None
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        row = temperature_grid(records, grid, logit, correct).orderBy("nll", "log_t").limit(1).collect()
        if not row or row[0].nll is None:
            return None
        best, step = row[0].log_t, (high - low) / (points - 1)
        low, high = max(-4.0, best - step), min(4.0, best + step)
    return float(2.718281828459045**best)


def temperature_grid(records: DataFrame, grid: Sequence[float], logit: str = "logit", correct: str = "correct") -> DataFrame:
    """log_t, nll for each point of the grid, in one pass."""
    y = F.col(correct).cast("double")

    def nll(log_t: float) -> Column:
        p = 1 / (1 + F.exp(-F.col(logit) / F.exp(F.lit(log_t))))
        p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
        return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))

    x = records.agg(F.array(*[F.struct(F.lit(float(t)).alias("log_t"), nll(t).alias("nll")) for t in grid]).alias("g"))
    return x.select(F.explode("g").alias("g")).select("g.*")


def risk_coverage(records: DataFrame, conf: str = "conf", correct: str = "correct", order: str = "id") -> DataFrame:
    """k, n, coverage, risk at every rank by descending confidence in [0, 1], ties by ``order``.

    The curve needs a total order: rows are ranked by ranges of (confidence, order), with the errors above each range added up
    before. ``aurc`` and ``risk_at`` read it.
    """
    x = records.select(F.col(conf).alias("_conf"), F.col(order).alias("_order"), (1 - F.col(correct).cast("double")).alias("_e"))
    x = ranked(x, [F.desc("_conf"), F.col("_order")], rank="k", sums={"e": "_e"}, count="n").withColumn("k", F.col("k").cast("int"))
    return x.select("k", "n", (F.col("k") / F.col("n")).alias("coverage"), (F.col("e") / F.col("k")).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve by trapezoids: all have the width 1 / n, so sums do."""
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("risk")))
    ends = (at(F.lit(1)) + at(F.col("n"))) / 2
    return curve.agg(F.coalesce(F.try_divide(F.sum("risk") - ends, F.max("n")), F.lit(0.0)).alias("aurc"))


def risk_at(curve: DataFrame, coverage: float = 0.8) -> DataFrame:
    return curve.filter(F.col("k") == F.greatest(F.lit(1), F.bround(F.lit(coverage) * F.col("n"), 0).cast("int"))).select("risk")


def auroc(records: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """Mid-rank ROC area from counts per distinct confidence; null if there is one class."""
    per = records.groupBy(conf).agg(F.sum(F.col(correct).cast("double")).alias("p"), F.sum(1 - F.col(correct).cast("double")).alias("q"))
    x = ranked(per, [F.col(conf)], rank="_k", sums={"_upto": "q"})
    x = x.select("p", "q", (F.col("p") * (F.col("_upto") - F.col("q") / 2)).alias("u"))
    return x.agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("q")).alias("auroc"))


def abstention_report(records: DataFrame, pred: str = "pred_abstain", gold: str = "should_abstain") -> DataFrame:
    p, g = F.col(pred), F.col(gold)
    tp, fp, fn = F.count_if(p & g), F.count_if(p & ~g), F.count_if(~p & g)
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return records.agg(zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confident_wrong(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Among impossible questions, the share answered by a span with confidence."""
    bad = F.coalesce(F.col("gave_span") & (F.col("confidence") >= threshold), F.lit(False))
    return records.filter("is_impossible").agg(F.avg(bad.cast("double")).alias("confident_wrong"))


# summaries and rewards


def order_scores(records: DataFrame, reach: DataFrame | None, keys: list[str], pred: str = "pred", names: str = "names") -> DataFrame:
    """keys, n_mentioned, inversions, violation_rate, hard, coverage of each summary against its timeline's names in order."""
    x = records.select(*keys, tx.mentions(F.col(pred), F.col(names)).alias("_m"), F.size(names).alias("_n"))
    pairs = x.select(*keys, F.posexplode("_m").alias("i", "a"), "_m").select(*keys, "a", F.explode(F.slice("_m", F.col("i") + 2, F.greatest(F.size("_m") - F.col("i") - 1, F.lit(0)))).alias("b")).filter(F.col("a.rank") > F.col("b.rank"))
    if reach is not None:
        rule = reach.select(F.col("a").alias("ra"), F.col("b").alias("rb")).distinct().withColumn("_h", F.lit(1))
        pairs = pairs.join(rule, (F.col("b.name") == F.col("ra")) & (F.col("a.name") == F.col("rb")), "left")
    else:
        pairs = pairs.withColumn("_h", F.lit(None).cast("int"))
    counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("inversions"), F.count("_h").alias("hard"))
    out = x.select(*keys, F.size("_m").alias("n_mentioned"), "_n").join(counted, keys, "left")
    n_pairs = F.col("n_mentioned") * (F.col("n_mentioned") - 1) / 2
    inv = F.coalesce("inversions", F.lit(0))
    return out.select(*keys, "n_mentioned", inv.alias("inversions"), F.coalesce(F.try_divide(inv, n_pairs), F.lit(0.0)).alias("violation_rate"), F.coalesce("hard", F.lit(0)).alias("hard"), F.try_divide(F.col("n_mentioned"), F.col("_n")).alias("coverage"))


def shaped_iou(preds: Column, gts: Column, duration_s: Column) -> Column:
    """Mean over true spans of the matched IoU; a match without overlap costs half its centre distance, at most 0.5."""
    matched = F.arrays_zip(greedy_matches(preds, gts).alias("m"), gts.alias("g"))

    def value(z: Column) -> Column:
        far = F.least(F.lit(1.0), center_distance(z["m"]["t0"], z["m"]["t1"], z["g"]["t0"], z["g"]["t1"]) / F.greatest(duration_s, F.lit(1e-6)))
        return F.when(z["m"]["iou"] > 0, z["m"]["iou"]).otherwise(-0.5 * far)

    return F.when(F.size(gts) > 0, F.aggregate(matched, F.lit(0.0), lambda a, z: a + value(z)) / F.size(gts)).otherwise(F.lit(0.0))


WEIGHTS = {"format": 1.0, "tiou": 1.0, "order": 0.5, "abstain": 0.5}


def reward(parsed: Column, gts: Column, abstain: Column, duration_s: Column, n_violations: Column | None = None, weights: dict[str, float] | None = None, lazy: float = -0.2, control: bool = False) -> Column:
    """Struct (reward, r_format, r_tiou, r_order, r_abstain, kind) of a parsed answer. control: no reward for abstaining."""
    w = {**WEIGHTS, **(weights or {})}
    none = F.lit(0.0)

    def terms(answer: Column) -> Column:
        kind = answer["kind"]
        r_format = F.when(kind != "bad", 1.0).otherwise(0.0)
        said = F.when(kind == "abstain", 1.0).otherwise(-1.0)
        r_tiou = F.when(abstain, none if control else said).when(kind == "abstain", lazy).when(kind.isin("span", "multi"), shaped_iou(answer["spans"], gts, duration_s)).otherwise(none)
        r_order = none if n_violations is None else 0.0 - F.least(F.lit(1.0), 0.34 * F.coalesce(n_violations, F.lit(0)))
        r_abstain = none if control else F.when(abstain, said).otherwise(none)
        return F.struct(r_format.alias("r_format"), r_tiou.alias("r_tiou"), r_order.alias("r_order"), r_abstain.alias("r_abstain"), kind.alias("kind"))

    def total(r: Column) -> Column:
        value = w["format"] * r["r_format"] + w["tiou"] * r["r_tiou"] + w["order"] * r["r_order"] + w["abstain"] * r["r_abstain"]
        return F.struct(value.alias("reward"), *[r[c].alias(c) for c in ("r_format", "r_tiou", "r_order", "r_abstain", "kind")])

    # one-element arrays compute the parsed answer and its terms once
    return F.get(F.transform(F.transform(F.array(parsed), terms), total), F.lit(0))


# efficiency


def efficiency_report(runs: DataFrame) -> DataFrame:
    """Means, token throughput, greatest memory and seconds per question; nulls of a column are left out of it."""
    c = F.col
    return runs.agg(
        F.avg("prefill_ms").alias("prefill_ms"),
        F.avg("decode_ms").alias("decode_ms"),
        F.try_divide(F.sum("n_new_tokens"), F.sum("decode_ms") / 1000).alias("tokens_s"),
        F.max("peak_vram_gb").alias("peak_vram_gb"),
        ((F.coalesce(F.sum("prefill_ms"), F.lit(0.0)) + F.coalesce(F.sum("decode_ms"), F.lit(0.0))) / 1000 / F.count(F.lit(1))).alias("gpu_s_per_q"),
        *[F.avg(c(x)).alias(x) for x in ("n_frames", "n_vis_tokens", "ctx_len")],
    )
