"""Operators on frame streams and timelines: runs, overlap joins, rasters, derived windows.

A frame table has one row per label at a time, a timeline one row per run: keys, run_id, label, t0, t1, half-open.
All of them partition by the given keys (dataset, video), so nothing is gathered across videos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.functions.intervals import overlap
from chronoleaf.operators.store import stored

#: Pairs that a task of an interval join compares, and its greatest number of tasks.
PAIRS, MOST_TASKS = 1 << 22, 10_000


def sessionize(df: DataFrame, key: str, order: list[str], micros: Column, gap_s: float) -> DataFrame:
    """Adds session (from 1 per key, new after a gap of more than gap_s) and t, the seconds since its start."""
    w = Window.partitionBy(key).orderBy(*order)
    x = df.withColumn("_us", micros)
    new = F.lag("_us").over(w).isNull() | (F.col("_us") - F.lag("_us").over(w) > int(gap_s * 1_000_000))
    x = x.withColumn("_new", new.cast("long"))
    x = x.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("_us").over(Window.partitionBy(key, "session"))
    return x.withColumn("t", (F.col("_us") - first) / 1_000_000).drop("_us", "_new")


def collapse_runs(frames: DataFrame, keys: list[str], at: str, label: str, unit: float = 1.0, tie: list[str] | None = None, nulls_break: bool = True) -> DataFrame:
    """Runs of equal labels: a run ends where the next one starts, the last one a unit after its last frame.

    Null labels break runs and are dropped at the end, as are labels that a later join does not know: dropping
    them never merges their neighbours. Output: keys, run_id (from 1), label, t0, t1, n_frames.
    """
    w = Window.partitionBy(*keys).orderBy(at, *(tie or []))
    x = frames if nulls_break else frames.filter(F.col(label).isNotNull())
    x = x.withColumn("_change", (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    x = x.withColumn("run_id", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*keys, "run_id").agg(F.first(label).alias("label"), F.min(at).alias("t0"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("n_frames"))
    after = F.lead("t0").over(Window.partitionBy(*keys).orderBy("run_id"))
    return runs.withColumn("t1", F.coalesce(after, F.col("_last") + F.lit(unit))).drop("_last").filter(F.col("label").isNotNull()).select(*keys, "run_id", "label", "t0", "t1", "n_frames")


def consecutive_runs(frames: DataFrame, keys: list[str], at: str, label: str, least: int = 2) -> DataFrame:
    """Runs of consecutive integer positions per label, of at least ``least`` positions: keys, label, f0, f1 (exclusive).

    One exchange and one sort, which spills; nothing is hashed, so a task's memory does not grow with distinct positions.
    """
    w = Window.partitionBy(*keys, "label").orderBy("_at")
    x = frames.select(*keys, F.col(label).alias("label"), F.col(at).alias("_at")).filter(F.col("label").isNotNull() & F.col(at).isNotNull())
    # only first and last rows of runs go on; rows of one position are neither, or one of each
    x = x.withColumns({"_first": F.coalesce(F.col("_at") - F.lag("_at").over(w) > 1, F.lit(True)), "_last": F.coalesce(F.lead("_at").over(w) - F.col("_at") > 1, F.lit(True))})
    x = x.filter("_first OR _last")
    # a run of one row is both its first and last
    end = F.when(F.col("_last"), F.col("_at")).otherwise(F.lead("_at").over(w))
    return x.withColumn("f1", end + 1).filter("_first").select(*keys, "label", F.col("_at").alias("f0"), "f1").filter(F.col("f1") - F.col("f0") >= least)


def runs_by_label(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """One row per label with its runs in order; first_run orders labels by first appearance."""
    spans = F.array_sort(F.collect_list(F.struct("t0", "t1")))
    return timeline.groupBy(*keys, "label").agg(spans.alias("spans"), F.min("run_id").alias("first_run"))


def overlapping(windows: DataFrame, timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Windows (keys, w0, w1, ...) with every run of the same keys that strictly overlaps them, clipped to (c0, c1)."""
    j = windows.join(timeline, keys)
    j = j.filter(overlap(F.col("t0"), F.col("t1"), F.col("w0"), F.col("w1")) > 0)
    return j.withColumn("c0", F.greatest("t0", "w0")).withColumn("c1", F.least("t1", "w1"))


def active_labels(windows: DataFrame, timeline: DataFrame, keys: list[str], window_id: str) -> DataFrame:
    """Labels active in each window, each once, by first appearance. Windows without any are kept with an empty array."""
    seen = overlapping(windows, timeline, keys).groupBy(*keys, window_id, "label").agg(F.min("run_id").alias("_first"))
    listed = seen.groupBy(*keys, window_id).agg(F.array_sort(F.collect_list(F.struct("_first", "label"))).alias("_l"))
    out = windows.join(listed, [*keys, window_id], "left")
    return out.withColumn("labels", F.coalesce(F.transform("_l", lambda x: x["label"]), F.array().cast("array<string>"))).drop("_l")


def overlap_join_global(left: DataFrame, right: DataFrame, bucket_s: float) -> DataFrame:
    """Interval join without a common key: l, r of all pairs of (t0, t1) that strictly overlap, each once.

    Time is cut into cells of bucket_s * 2**level, and an interval lives at the least level whose cells are as long as it
    is, in at most two of them. To meet longer intervals it also visits the cells it touches at every level above, up to the
    longest interval's, so a row becomes at most two rows a level: the logarithm of the lengths, however long an interval is.
    Residents of the left meet residents and visitors of the right, and its visitors meet residents, so that two short
    intervals never meet in a large cell. A pair comes out of the cell where its overlap starts. A cell with many pairs is
    cut: each part takes some of its left rows and all of its right ones.
    """
    length = F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length / bucket_s, F.lit(1.0))))).cast("int")
    sides = {"l": left, "r": right}
    top = max([d.agg(F.max(level)).first()[0] or 0 for d in sides.values()])

    def dealt(x: DataFrame, y: DataFrame) -> DataFrame:
        """Rows of x and y that share a cell, a task for about ``PAIRS`` of them: small tables can have any number of pairs."""
        cell = ["_level", "_cell"]
        n = x.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nx")).join(y.groupBy(*cell).agg(F.count(F.lit(1)).alias("_ny")), cell)
        n = stored(n.select(*cell, (F.col("_nx") * F.col("_ny")).alias("_pairs"), F.ceil(F.col("_nx") * F.col("_ny") / PAIRS).cast("int").alias("_parts")), "cells")
        total = n.agg(F.sum("_pairs")).first()[0] or 0
        least = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), x.sparkSession.sparkContext.defaultParallelism)
        tasks = min(max(-(-total // PAIRS), least), MOST_TASKS)
        parts = n.select(*cell, "_parts")
        x = x.join(parts, cell).withColumn("_part", F.pmod(F.xxhash64("l"), "_parts").cast("int")).drop("_parts")
        y = y.join(parts, cell).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        return x.repartition(tasks, *cell, "_part").hint("merge").join(y.repartition(tasks, *cell, "_part"), [*cell, "_part"])

    def cells(side: str) -> DataFrame:
        width = lambda k: F.lit(float(bucket_s)) * F.pow(F.lit(2.0), k)
        at = lambda k: F.sequence(F.floor(F.col("t0") / width(k)), F.floor(F.col("t1") / width(k)))
        x = sides[side].filter("t1 > t0").select(F.struct("*").alias(side), "t0", "t1", level.alias(f"_own_{side}"))
        x = x.select("*", F.explode(F.sequence(F.col(f"_own_{side}"), F.lit(top))).alias("_level"))
        return x.select(side, F.col("t0").alias(f"_{side}0"), F.col("t1").alias(f"_{side}1"), f"_own_{side}", "_level", F.explode(at(F.col("_level"))).alias("_cell"))

    a, b = cells("l"), cells("r")
    at_home = lambda side: F.col(f"_own_{side}") == F.col("_level")
    met = dealt(a.filter(at_home("l")), b).unionByName(dealt(a.filter(~at_home("l")), b.filter(at_home("r"))))
    lo = F.greatest("_l0", "_r0")
    first = F.floor(lo / (F.lit(float(bucket_s)) * F.pow(F.lit(2.0), F.col("_level"))))
    return met.filter((F.least("_l1", "_r1") - lo > 0) & (first == F.col("_cell"))).select("l", "r")


def rasterize(timeline: DataFrame, keys: list[str], duration: DataFrame, hz: float = 1.0, background: str | None = None) -> DataFrame:
    """Dense labels (keys, sec, label) of 0..round(duration * hz); where runs overlap, the later run_id wins."""
    n = F.bround(F.col("duration_s") * hz, 0).cast("int")
    grid = duration.withColumn("_n", n).filter("_n > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("sec"))
    edge = lambda c: F.greatest(F.lit(0), F.bround(F.col(c) * hz, 0).cast("int"))
    x = timeline.select(*keys, "run_id", "label", edge("t0").alias("_a"), edge("t1").alias("_b")).join(duration.select(*keys, n.alias("_n")), keys)
    painted = x.withColumn("_b", F.least("_b", "_n")).filter("_b > _a").select(*keys, "run_id", "label", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("sec"))
    top = painted.groupBy(*keys, "sec").agg(F.max_by("label", "run_id").alias("label"))
    out = grid.join(top, [*keys, "sec"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(background))) if background is not None else out


def majority_per_second(frames: DataFrame, keys: list[str], at: str, label: str) -> DataFrame:
    """The most frequent label of each whole second, ties to the least label."""
    counted = frames.groupBy(*keys, F.floor(F.col(at)).alias("sec"), F.col(label).alias("label")).count()
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "sec").orderBy(F.desc("count"), "label")))
    return ranked.filter("_r = 1").select(*keys, "sec", "label")


def next_run(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Adds label, t0, t1 of the following run as next_*; null for the last."""
    w = Window.partitionBy(*keys).orderBy("run_id")
    return timeline.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("label", "t0", "t1")])


def durations(timeline: DataFrame, keys: list[str], declared: DataFrame | None = None) -> DataFrame:
    """keys, duration_s: the declared one where there is one, else the greatest end."""
    ends = timeline.groupBy(*keys).agg(F.max("t1").alias("_end"))
    if declared is None:
        return ends.withColumnRenamed("_end", "duration_s")
    x = ends.join(declared.select(*keys, F.col("duration_s").alias("_own")), keys, "full")
    return x.select(*keys, F.coalesce("_own", "_end").alias("duration_s"))


def lookup(df: DataFrame, vocab: DataFrame, label: str, name: str = "name", ids: str = "id") -> DataFrame:
    """Adds <label>_id by exact, then case-insensitive name; unknown names stay null. The vocabulary is a parameter table."""
    exact = vocab.select(F.col(name).alias("_n"), F.col(ids).alias("_i")).dropDuplicates(["_n"])
    folded = vocab.groupBy(F.lower(name).alias("_ln")).agg(F.min(ids).alias("_li"))
    x = df.join(exact, F.col(label) == F.col("_n"), "left").join(folded, F.lower(label) == F.col("_ln"), "left")
    return x.withColumn(f"{label}_id", F.coalesce("_i", "_li")).drop("_n", "_i", "_ln", "_li")


def names_of(df: DataFrame, vocab: DataFrame, label_id: str, out: str = "label") -> DataFrame:
    """Adds the name of an id; an unknown id is its own name."""
    known = vocab.groupBy(F.col("id").alias("_i")).agg(F.min("name").alias("_n"))
    return df.join(known, F.col(label_id) == F.col("_i"), "left").withColumn(out, F.coalesce("_n", F.col(label_id).cast("string"))).drop("_i", "_n")


def absent_labels(videos: DataFrame, vocab: DataFrame, timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of the vocabulary that a video never shows: what an unanswerable question may ask for."""
    names = vocab.agg(F.array_sort(F.collect_set("name")).alias("_names"))  # one row
    every = videos.select(*keys).join(F.broadcast(names)).select(*keys, F.explode("_names").alias("label"))
    return every.join(timeline.select(*keys, "label").distinct(), [*keys, "label"], "left_anti")
