"""Metric bundles, and evaluation of a prediction table into result cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoleaf.functions import text as tx
from chronoleaf.operators import graph as g
from chronoleaf.operators import metrics as m
from chronoleaf.operators import text_scores as ts
from chronoleaf.operators.ranks import ranked
from chronoleaf.operators.report import DESCRIPTORS


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))
    return out


def segment_bundle(dense: DataFrame, pred: DataFrame, gt: DataFrame, keys: list[str], background: str | None = None, overlaps: Sequence[float] = (0.1, 0.25, 0.5)) -> DataFrame:
    """keys, frame_acc, edit and segF1@ per overlap. dense (keys, pred, gt); pred, gt: runs (keys, run_id, label, t0, t1)."""
    sides = pred.select(*keys, "run_id", "label", F.lit("pred").alias("side")).union(gt.select(*keys, "run_id", "label", F.lit("gt").alias("side")))
    codes = sides.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).agg(F.array_sort(F.collect_list("label")).alias("_all"))
    coded = sides.join(F.broadcast(codes)).withColumn("code", (F.array_position("_all", F.col("label")) - 1).cast("int"))
    out = m.edit_score(coded, keys, "pred", "gt").join(m.frame_accuracy(dense, keys, background=background), keys, "left")
    f1s = m.segmental_f1s(pred, gt, keys, overlaps).withColumnsRenamed({f"f1_{i}": f"segF1@{int(o * 100)}" for i, o in enumerate(overlaps)})
    return out.join(f1s, keys, "left")


def detection_bundle(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row. Scored rows (item, cls, score, label): det_mAP, det_macro_f1, n; label lists: set metrics, with macro F1 as det_mAP."""
    if "score" in records.columns:
        mean = m.average_precision(records).agg(F.avg("ap").alias("det_mAP"))
        return side_by_side(mean, m.macro_f1(records, threshold).withColumnRenamed("macro_f1", "det_macro_f1"), records.agg(F.count_distinct("item").alias("n")))
    x = m.set_report(records)
    return x.withColumn("det_mAP", F.col("macro_f1"))


def temporal_consistency(records: DataFrame, reach: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row (temporal_consistency, checked): the share of answers that go with the graph, among those that can be tested.

    A record is tested by the first form it has: labeled_spans (label, t0, t1), ordered_labels, whose places are their times,
    or step with phase. A record with none of these is left out.
    """
    has = lambda c: (F.size(c) > 0) if c in records.columns else F.lit(False)
    pair = F.col("step").isNotNull() & F.col("phase").isNotNull() if "step" in records.columns else F.lit(False)
    form = F.when(has("labeled_spans"), 1).when(has("ordered_labels"), 2).when(pair, 3)
    x = records.withColumn("_form", form).filter("_form is not null")
    parts = []
    if "labeled_spans" in records.columns:
        s = x.filter("_form = 1").select(*keys, F.posexplode("labeled_spans").alias("run_id", "s"))
        parts.append(s.select(*keys, "run_id", "s.label", F.col("s.t0").cast("double").alias("t0"), F.col("s.t1").cast("double").alias("t1")))
    if "ordered_labels" in records.columns:
        s = x.filter("_form = 2").select(*keys, F.posexplode("ordered_labels").alias("run_id", "label"))
        parts.append(s.select(*keys, "run_id", "label", F.col("run_id").cast("double").alias("t0"), (F.col("run_id") + 1).cast("double").alias("t1")))
    good = []
    for p in parts:
        good.append(g.violation_counts(p, reach, keys).select((F.col("n_violations") == 0).alias("ok")))
    if "step" in records.columns:
        good.append(g.step_phase_consistent(x.filter("_form = 3").select("step", "phase"), steps).select(F.col("consistent").alias("ok")))
    every = good[0]
    for p in good[1:]:
        every = every.union(p)
    return every.agg(F.avg(F.col("ok").cast("double")).alias("temporal_consistency"), F.count(F.lit(1)).alias("checked"))


def qa_bundle(records: DataFrame, reach: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row: qa_em, qa_f1, n and temporal_consistency of (pred, gold and the forms of ``temporal_consistency``)."""
    both = m.qa_report(m.qa_pairs(records)).select(F.col("em").alias("qa_em"), F.col("f1").alias("qa_f1"), "n")
    return side_by_side(both, temporal_consistency(records, reach, steps, keys).select("temporal_consistency"))


def reliability_bundle(records: DataFrame, order: str, temperature: float | None = None, n_bins: int = 15) -> DataFrame:
    """One row of all confidence metrics of (conf, correct); ``order`` breaks ties of confidence."""
    curve = m.risk_coverage(records, order=order)
    return side_by_side(
        m.calibration_error(m.calibration_bins(records, n_bins=n_bins)),
        m.calibration_error(m.adaptive_bins(records, order, n_bins=n_bins)).withColumnRenamed("ece", "ece_adapt"),
        m.aurc(curve),
        m.risk_at(curve, 0.8).withColumnRenamed("risk", "risk@0.8cov"),
        m.auroc(records).withColumnRenamed("auroc", "conf_auroc"),
        records.agg(F.lit(temperature).cast("double").alias("T"), F.count(F.lit(1)).alias("n")),
    )


def summary_bundle(records: DataFrame, reach: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row: mean order violation rate, hard violations in all, mean coverage of those that have a timeline, n."""
    x = m.order_scores(records, reach, keys)
    return x.agg(
        F.avg("violation_rate").alias("summ_order_violation_rate"),
        F.sum("hard").cast("long").alias("summ_hard_order_violations"),
        F.avg("coverage").alias("summ_coverage_recall"),
        F.count(F.lit(1)).alias("n"),
    )


def event_detection(pred: DataFrame, gt: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision and recall of rare events, and false alarms an hour.

    A predicted event (keys, t0, t1) is right if it overlaps a true one, a true one is found if a predicted one overlaps it.
    """
    p = pred.select(*keys, F.struct("t0", "t1").alias("p")).distinct()
    t = gt.select(*keys, F.struct("t0", "t1").alias("g")).distinct()
    met = p.join(t, keys).filter(F.least("p.t1", "g.t1") > F.greatest("p.t0", "g.t0"))
    right, found = met.select(*keys, "p").distinct(), met.select(*keys, "g").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias(name))
    x = side_by_side(n(p, "_p"), n(right, "_r"), n(t, "_t"), n(found, "_f"), durations.agg((F.sum("duration_s") / 3600).alias("_h")))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return x.select(share("_r", "_p").alias("precision"), share("_f", "_t").alias("recall"), F.try_divide(F.col("_p") - F.col("_r"), F.col("_h")).alias("alarms_h"))


#: What every metric of a prediction row is averaged from; null rows are left out of it.
def _values(columns: list[str], thresholds: Sequence[float]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if {"pred_spans", "gt_spans"} <= set(columns):
        out |= {f"r{k}@{t}": F.col(f"r{k}_{int(t * 100)}") for k in (1, 5) for t in thresholds} | {"miou": F.col("iou")}
    if {"pred_min", "gt_min"} <= set(columns):
        e = F.abs(F.col("pred_min") - F.col("gt_min"))
        out |= {"rsd_mae_min": e, "rsd_within5": (e <= 5).cast("double")}
    if {"pred", "gold"} <= set(columns):
        out |= {"qa_em": tx.exact_match(F.col("pred"), F.col("gold")), "qa_f1": tx.token_f1(F.col("pred"), F.col("gold"))}
    return out


def evaluate(predictions: DataFrame, unit: str, interval_of: str | None = None, resamples: int = 1000, thresholds: Sequence[float] = (0.3, 0.5, 0.7), seed: int = 0) -> DataFrame:
    """Result cells of a prediction table: one row per combination of the descriptors it has (backend, method, dataset, task, ...).

    metrics and by_length hold what the columns allow: pred_spans and gt_spans (grounding), pred_min and gt_min (remaining
    duration), pred and gold (answers); duration_s gives the length bucket. ``interval_of`` names a metric whose bootstrap
    interval over ``unit`` goes to ci. All metrics of all cells come from one grouping by cell and bucket.
    """
    cell = [c for c in DESCRIPTORS if c in predictions.columns]
    x = predictions
    if {"pred_spans", "gt_spans"} <= set(x.columns):
        x = m.grounding_scores(x, thresholds)
    else:
        x = x.withColumn("len_bucket", m.length_bucket(F.col("duration_s")))
    values = _values(predictions.columns, thresholds)
    scored = x.select(*cell, unit, "len_bucket", *[v.alias(f"v_{i}") for i, v in enumerate(values.values())])
    sums = [f(F.col(f"v_{i}")).alias(f"{n}_{i}") for i in range(len(values)) for n, f in (("s", F.sum), ("c", F.count))]
    per = scored.groupBy(*cell, "len_bucket").agg(F.count(F.lit(1)).alias("n"), *sums)

    def metrics(df: DataFrame) -> Column:
        pairs = [F.struct(F.lit("n_items").alias("k"), F.col("n").cast("double").alias("v"))]
        pairs += [F.struct(F.lit(name).alias("k"), F.try_divide(F.col(f"s_{i}"), F.col(f"c_{i}")).alias("v")) for i, name in enumerate(values)]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))

    totals = per.groupBy(*cell).agg(F.sum("n").alias("n"), *[F.sum(f"{k}_{i}").alias(f"{k}_{i}") for i in range(len(values)) for k in "sc"])
    by = per.withColumn("_m", metrics(per)).groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("len_bucket", "_m"))).alias("by_length"))
    over = totals.withColumn("metrics", metrics(totals)).select(*cell, "metrics").alias("a")
    by = by.alias("b")
    out = over.join(by, _all([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cell])).select("a.*", "b.by_length")
    if interval_of:
        i = list(values).index(interval_of)
        ci = m.bootstrap_interval(scored, f"v_{i}", unit, resamples, seed, by=cell).alias("c")
        out = out.alias("a").join(ci, _all([F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in cell]), "left")
        out = out.select("a.*", F.create_map(F.lit("overall"), F.array("c.lo", "c.hi")).alias("ci"))
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# families whose records are more than one row of values: each gives (cell, len_bucket, n_items and metrics)


def by_bucket(records: DataFrame) -> DataFrame:
    """Each record twice: in all lengths, and in the bucket of its duration_s."""
    return records.withColumn("len_bucket", F.explode(F.array(F.lit(m.TOTAL), m.length_bucket(F.col("duration_s")))))


def averaged(records: DataFrame, cell: list[str], metrics: Sequence[str]) -> DataFrame:
    return by_bucket(records).groupBy(*cell, "len_bucket").agg(F.count(F.lit(1)).alias("n_items"), *[F.avg(F.col(f"`{c}`")).alias(c) for c in metrics])


def segmentation_family(dense: DataFrame, pred: DataFrame, gt: DataFrame, durations: DataFrame, cell: list[str], video: list[str], overlaps: Sequence[float] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Means over videos of ``segment_bundle``. All tables have cell and video columns; durations: cell, video, duration_s."""
    keys = [*cell, *video]
    x = segment_bundle(dense, pred, gt, keys, overlaps=overlaps).join(durations.select(*keys, "duration_s"), keys)
    return averaged(x, cell, ["frame_acc", "edit", *(f"segF1@{int(o * 100)}" for o in overlaps)])


def detection_family(scored: DataFrame, cell: list[str], item: str = "item", threshold: float = 0.5) -> DataFrame:
    """scored (cell, item, cls, score, label, duration_s): mean over classes of AP and F1 at the threshold."""
    x = by_bucket(scored).withColumn("_c", F.struct(*cell, "len_bucket", "cls"))
    mean = lambda df, value, name: df.groupBy("_c.len_bucket", *[f"_c.{c}" for c in cell]).agg(F.avg(value).alias(name))
    n = x.groupBy(*cell, "len_bucket").agg(F.count_distinct(item).alias("n_items"))
    keys = [*cell, "len_bucket"]
    return n.join(mean(m.average_precision(x, "_c"), "ap", "det_mAP"), keys, "left").join(mean(m.class_f1(x, threshold, "_c"), "f1", "det_macro_f1"), keys, "left")


def summary_family(records: DataFrame, reach: DataFrame | None, cell: list[str], item: str = "item") -> DataFrame:
    """records (cell, item, pred, names, duration_s, and gold if there are references): order, coverage, and text scores.

    Document frequencies of n-grams are those of all references of the table.
    """
    x = m.order_scores(records, reach, [*cell, item]).select(*cell, item, F.col("violation_rate").alias("summ_order_violation_rate"), F.col("coverage").alias("summ_coverage_recall"), F.col("hard").cast("double").alias("_hard"))
    x = x.join(records.select(*cell, item, "duration_s"), [*cell, item])
    names = ["summ_order_violation_rate", "summ_coverage_recall", "_hard"]
    if "gold" in records.columns:
        texts = records.withColumn("_id", F.struct(*cell, item))
        scores = ts.cider(texts, "_id", "pred", "gold").select("_id.*", F.col("cider").alias("summ_cider"))
        scores = scores.join(ts.meteor(texts.withColumn("_m", F.to_json("_id")), "_m", "pred", "gold").select(F.col("_m"), F.col("meteor").alias("summ_meteor")), F.to_json(F.struct(*cell, item)) == F.col("_m")).drop("_m")
        x = x.join(scores, [*cell, item], "left")
        names += ["summ_cider", "summ_meteor"]
    out = averaged(x, cell, names)
    return out.withColumn("summ_hard_order_violations", F.round(F.col("_hard") * F.col("n_items"))).drop("_hard")


def reliability_family(records: DataFrame, cell: list[str], order: str, n_bins: int = 15, coverage: float = 0.8) -> DataFrame:
    """records (cell, conf, correct, order, duration_s): calibration errors, risk-coverage and ROC areas of each cell.

    Ranks and running sums are by ranges within the cell, so a cell that holds most records is no task of its own.
    """
    keys = [*cell, "len_bucket"]
    x = by_bucket(records.select(*cell, "conf", F.col("correct").cast("double").alias("correct"), F.col(order).alias("_o"), "duration_s")).withColumn("_e", 1 - F.col("correct"))
    gap = F.abs(F.avg("correct") - F.avg("conf")) * F.count(F.lit(1))

    def error(binned: DataFrame, name: str) -> DataFrame:
        per = binned.groupBy(*keys, "bin").agg(gap.alias("_g"), F.count(F.lit(1)).alias("_n"))
        return per.groupBy(*keys).agg((F.sum("_g") / F.sum("_n")).alias(name), F.sum("_n").alias("n_items"))

    width = F.greatest(F.lit(0), F.least(F.width_bucket(F.col("conf"), F.lit(0.0), F.lit(1.0), F.lit(n_bins)), F.lit(n_bins)) - 1)
    up = ranked(x, [F.col("conf"), F.col("_o")], by=keys, rank="_k", count="_n")
    rank, size, extra = F.col("_k") - 1, F.floor(F.col("_n") / n_bins), F.col("_n") % n_bins
    first = extra * (size + 1)
    equal = F.when(rank < first, F.floor(rank / (size + 1))).otherwise(extra + F.floor(F.try_divide(rank - first, size)))
    down = ranked(x, [F.desc("conf"), F.col("_o")], by=keys, rank="_k", sums={"_s": "_e"}, count="_n")
    risk, at = F.col("_s") / F.col("_k"), lambda k: F.max(F.when(F.col("_k") == k, F.col("_s") / F.col("_k")))
    stop = F.greatest(F.lit(1), F.bround(F.lit(coverage) * F.col("_n"), 0))
    curve = down.groupBy(*keys).agg(((F.sum(risk) - (at(F.lit(1)) + at(F.col("_n"))) / 2) / F.max("_n")).alias("aurc"), at(stop).alias(f"risk@{coverage}cov"))
    per = x.groupBy(*keys, "conf").agg(F.sum("correct").alias("_p"), F.sum("_e").alias("_q"))
    per = ranked(per, [F.col("conf")], by=keys, rank="_k", sums={"_upto": "_q"})
    area = per.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_p") * (F.col("_upto") - F.col("_q") / 2)), F.sum("_p") * F.sum("_q")).alias("conf_auroc"))
    return error(x.withColumn("bin", width), "ece").join(error(up.withColumn("bin", equal), "ece_adapt").drop("n_items"), keys).join(curve, keys).join(area, keys)


def family_cells(families: Sequence[DataFrame]) -> DataFrame:
    """Result cells (descriptors, metrics, by_length) of tables (descriptors, len_bucket, metrics): ``report.flatten`` takes them.

    Metrics of one cell from several families are put together; undefined ones are left out.
    """
    rows = None
    for f in families:
        known = [c for c in DESCRIPTORS if c in f.columns]
        values = [c for c in f.columns if c not in known and c != "len_bucket"]
        pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("double").alias("v")) for c in values]), lambda p: p["v"].isNotNull())
        x = f.select(*[F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in DESCRIPTORS], "len_bucket", F.explode(pairs).alias("p"))
        rows = x if rows is None else rows.unionByName(x)
    per = rows.groupBy(*DESCRIPTORS, "len_bucket", F.col("p.k").alias("k")).agg(F.max("p.v").alias("v"))
    maps = per.groupBy(*DESCRIPTORS, "len_bucket").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_m"))
    total = F.col("len_bucket") == m.TOTAL
    entries = F.collect_list(F.when(~total, F.struct("len_bucket", "_m")))
    return maps.groupBy(*DESCRIPTORS).agg(F.first(F.when(total, F.col("_m")), ignorenulls=True).alias("metrics"), F.map_from_entries(entries).alias("by_length"))
