"""Task items from timelines: one lazy plan per family, unioned, with ids, prompts, answers and targets.

Random picks of the usual recipe are hashes of (seed, video), so every run builds the same items.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from chronoleaf.functions import answers as an
from chronoleaf.functions.intervals import overlap, probe_times, regime
from chronoleaf.operators.selection import draw
from chronoleaf.operators.timeline import active_labels, runs_by_label

KEYS = ["dataset", "video_id"]
SEGMENT = "struct<label:string,t0:double,t1:double>"
TARGET = f"struct<spans:array<struct<t0:double,t1:double>>,labels:array<string>,segments:array<{SEGMENT}>,minutes:double,text:string,answer:string,count:int,timeline:array<{SEGMENT}>,window:array<double>,abstain:boolean>"
# Events that no procedure graph here has; questions about them have no answer.
ABSENT = ("the anastomotic leak test", "the stapler misfire recovery", "the intraoperative cholangiogram", "the conversion to open surgery", "the specimen frozen-section wait")
SYSTEM = {
    "t1": "Give the time span of the event in this operation as <answer>[start_seconds, end_seconds]</answer>, or <answer>ABSTAIN</answer> if it does not occur.",
    "t2": 'Segment the operation: <answer>[["<label>", start_seconds, end_seconds], ...]</answer>.',
    "t3": "Say how many minutes of surgery remain as <answer>MINUTES</answer>.",
    "t4": "List what is active in the window, comma-separated, in <answer>...</answer>, or <answer>none</answer>.",
    "t5": "Answer the question about this operation in <answer>...</answer>.",
    "t6": "Summarize the interval in order of time in <answer>...</answer>.",
}
N_FRAMES = 64


def pick(n: Column, seed: int, *parts: Column) -> Column:
    """An index in 0..n-1 by hash; null where n < 1."""
    h = F.conv(F.substring(draw(seed, *parts), 1, 12), 16, 10).cast("long")
    return F.when(n >= 1, F.pmod(h, F.greatest(n, F.lit(1)).cast("long"))).cast("int")


def target(**fields: Column) -> Column:
    """The target struct with the given fields, nulls elsewhere."""
    names = [x.split(":")[0] for x in ("spans", "labels", "segments", "minutes", "text", "answer", "count", "timeline", "window", "abstain")]
    given = {"abstain": F.lit(False), "spans": F.array().cast(an.SPANS)} | fields
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(TARGET)


def rounded(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.round(s["t0"], 1).alias("t0"), F.round(s["t1"], 1).alias("t1")))


def tenths(t: np.ndarray) -> np.ndarray:
    """``intervals.tenths`` of numbers of either sign."""
    y = np.abs(t) * 10
    n = np.floor(y)
    return (np.copysign(1, t) * (n + (y - n >= 0.5))).astype(np.int64)


def shown(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Times, each list of them as text: what ``answers.format_ts`` gives, joined by commas."""
    plain = np.abs(flat) < 1e15
    n = np.maximum(tenths(np.where(plain, flat, 0.0)), 0)
    text = pc.binary_join_element_wise(pa.array(n // 10).cast(pa.string()), pa.array(list("0123456789")).take(pa.array(n % 10)), ".")
    if not plain.all():
        text = pa.array([x if ok else f"{max(v, 0.0):.1f}" for x, ok, v in zip(text.to_pylist(), plain, flat.tolist(), strict=True)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text), ", ")


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row for each combination of the keys, and for each row its place among them. Keys are compared by their bits."""
    bits = np.column_stack([np.ascontiguousarray(k, np.float64) for k in keys])
    _, first, of = np.unique(bits.view(f"V{8 * len(keys)}").ravel(), return_index=True, return_inverse=True)
    return first, of


def grids(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The times of spans from x to y, and their text."""
    i = np.arange(N_FRAMES)
    t = x[:, None] + i * ((y - x) / (N_FRAMES - 1))[:, None]
    kept = (y > x)[:, None] | (i == 0)
    t[:, 0] = x
    offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
    flat = t[kept]
    plain = np.abs(flat) < 1e15
    flat = np.where(plain, tenths(np.where(plain, flat, 0.0)) / 10.0, flat)
    known = known[np.repeat(np.arange(len(x)), np.diff(offsets))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, mask=~known)), shown(np.where(known, flat, 0.0), offsets)


@F.arrow_udf(StructType([StructField("t_sec", ArrayType(DoubleType())), StructField("shown", StringType())]))
def sampled(a: pa.Array, b: pa.Array) -> pa.Array:
    """``intervals.sample_times`` of ``N_FRAMES`` points and their text, for whole batches: millions of items have tens of times each.

    The many items of a batch that share a span, as all probes at a time and all questions on a video do, share its grid.
    """
    x, y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (a, b))
    known = a.is_valid().to_numpy(zero_copy_only=False)
    first, of = distinct(x, y, known)
    made, of = grids(x[first], y[first], known[first]), pa.array(of)
    return pa.StructArray.from_arrays([c.take(of) for c in made], names=["t_sec", "shown"])


@F.arrow_udf(StringType())
def shown_times(times: pa.Array) -> pa.Array:
    """The text of arrays of times; equal arrays of a batch are written once."""
    n = pc.fill_null(pc.list_value_length(times), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(times.flatten(), 0.0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)])
    if not len(flat):
        return shown(flat, ends)
    at = np.minimum(ends[:-1], len(flat) - 1)
    first, of = distinct(n, flat[at], flat[np.maximum(ends[1:] - 1, 0)])
    # arrays that agree in length and ends are compared in full; one that differs from the first of these stands for itself
    place = np.arange(len(flat)) - np.repeat(ends[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    same = np.ones(len(n), bool)
    same[row[flat.view(np.int64) != flat.view(np.int64)[np.repeat(ends[:-1][first][of], n) + place]]] = False
    others = np.flatnonzero(~same)
    of = of.copy()
    of[others] = len(first) + np.arange(len(others))
    rows = np.concatenate([first, others])
    sizes = n[rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    picked = np.repeat(ends[:-1][rows] - offsets[:-1], sizes) + np.arange(offsets[-1])
    return shown(flat[picked], offsets).take(pa.array(of))


#: How a prompt starts; the times of its frames come next.
OPENS = "Frames sampled at t = ["


def item(df: DataFrame, task: str, sub_type: Column | str, user: Column, assistant: Column, goal: Column, query: Column | None = None, window: tuple[Column, Column] | None = None, probe: Column | None = None, number: Column | None = None) -> DataFrame:
    """The item of each row of ``df`` (dataset, domain, center, video_id, duration_s, ...) before ``finished``: its prompt lacks the times.

    What is sorted and shuffled for ids are such rows of a few dozen bytes, not records with two lists of times.
    """
    sub = sub_type if isinstance(sub_type, Column) else F.lit(sub_type)
    a, b = window or (F.lit(0.0), F.col("duration_s"))
    return df.select(
        "dataset",
        "domain",
        "center",
        "video_id",
        F.lit(task).alias("task"),
        sub.alias("sub_type"),
        regime(F.col("duration_s"), query if query is not None else F.lit("")).alias("regime"),
        F.col("duration_s").cast("double").alias("duration_s"),
        (probe if probe is not None else F.lit(None)).cast("double").alias("probe_t_s"),
        a.cast("double").alias("_a"),
        b.cast("double").alias("_b"),
        F.lit(window is not None).alias("_windowed"),
        user.alias("_user"),
        assistant.alias("_said"),
        goal.alias("target"),
        (number if number is not None else F.lit(None)).cast("long").alias("_k"),
    )


def grid() -> Column:
    """No times: ``finished`` puts them into the prompt."""
    return F.array().cast("array<double>")


def finished(drafts: DataFrame) -> DataFrame:
    """Whole item records: with frame times, and messages that show them."""
    x = drafts.withColumn("_f", sampled("_a", "_b"))
    system = None
    for task, text in SYSTEM.items():
        system = F.when(F.col("task") == task, text) if system is None else system.when(F.col("task") == task, text)
    user = F.concat(F.lit(OPENS), F.col("_f.shown"), F.substring("_user", len(OPENS) + 1, 1 << 30))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    made = {
        "frames": F.struct(F.col("_f.t_sec").alias("t_sec"), F.when(F.col("_windowed"), F.array("_a", "_b")).alias("window")),
        "messages": F.array(message("system", system), message("user", user), message("assistant", F.col("_said"))),
        "target": F.col("target"),
    }
    first = ["dataset", "domain", "center", "video_id", "task", "sub_type", "regime", "duration_s", "probe_t_s"]
    return x.select(*first, *[c.alias(n) for n, c in made.items()], *[c for c in drafts.columns if c == "id"])


def family(drafts: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Whole records of a family's drafts, which stay at hand as ``drafts``."""

    @wraps(drafts)
    def whole(*args, **given) -> DataFrame:
        return finished(drafts(*args, **given))

    whole.drafts = drafts
    return whole


@family
def grounding_items(videos: DataFrame, timeline: DataFrame, kind: str, multi: bool = True, least_s: float = 0.0) -> DataFrame:
    """One question per label: all its runs, or only the first unless ``multi``; runs shorter than least_s are left out."""
    runs = runs_by_label(timeline.filter((F.col("kind") == kind) & (F.col("t1") - F.col("t0") >= least_s)), KEYS)
    x = runs.join(videos, KEYS)
    spans = F.col("spans") if multi else F.slice("spans", 1, 1)
    q = F.concat(F.lit("When is the "), F.col("label"), F.lit(" performed?")) if kind != "action" else F.concat(F.lit("When does '"), F.col("label"), F.lit("' occur?"))
    sub = F.when(F.size(spans) > 1, f"{kind}_multi").otherwise(kind) if kind == "phase" else F.lit(kind)
    return item(x, "t1", sub, an.user_grounding(grid(), F.col("duration_s"), q), an.answer_spans(spans), target(spans=rounded(spans)), q)


@family
def relative_items(videos: DataFrame, timeline: DataFrame, seed: int = 0) -> DataFrame:
    """What happens right after a drawn phase."""
    w = Window.partitionBy(*KEYS)
    x = timeline.filter("kind = 'phase'").select(*KEYS, "label", F.row_number().over(w.orderBy("run_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"), *[F.lead(c).over(w.orderBy("run_id")).alias(f"next_{c}") for c in ("t0", "t1")])
    x = x.filter(F.col("k") - 1 == pick(F.col("n") - 1, seed, F.lit("relative"), F.col("video_id"))).join(videos, KEYS)
    q = F.concat(F.lit("What happens right after the "), F.col("label"), F.lit("?"))
    spans = F.array(F.struct(F.col("next_t0").alias("t0"), F.col("next_t1").alias("t1")))
    return item(x, "t1", "relative", an.user_grounding(grid(), F.col("duration_s"), q), an.answer_spans(spans), target(spans=rounded(spans)), q)


@family
def cross_scale_items(videos: DataFrame, timeline: DataFrame, steps: DataFrame) -> DataFrame:
    """The first step of a video that has a parent, asked within that phase. steps: name, parent (phase name)."""
    first = timeline.filter("kind = 'step'").groupBy(*KEYS).agg(F.min(F.struct("run_id", "label", "t0", "t1")).alias("f"))
    x = first.select(*KEYS, "f.*").join(steps.select(F.col("name").alias("label"), "parent").filter("parent is not null"), "label").join(videos, KEYS)
    q = F.concat(F.lit("During the "), F.col("parent"), F.lit(", when is "), F.col("label"), F.lit(" performed?"))
    spans = F.array(F.struct("t0", "t1"))
    return item(x, "t1", "cross_scale", an.user_grounding(grid(), F.col("duration_s"), q), an.answer_spans(spans), target(spans=rounded(spans)), q)


@family
def nl_items(videos: DataFrame, queries: DataFrame) -> DataFrame:
    """Questions that come with the data: queries (dataset, video_id, query, t0, t1)."""
    x = queries.join(videos, KEYS)
    spans = F.array(F.struct("t0", "t1"))
    return item(x, "t1", "nl", an.user_grounding(grid(), F.col("duration_s"), F.col("query")), an.answer_spans(spans), target(spans=rounded(spans)), F.col("query"))


@family
def segmentation_items(videos: DataFrame, timeline: DataFrame, kind: str) -> DataFrame:
    """All phases or steps of a video in order."""
    row = F.struct("run_id", "label", F.round("t0", 1).alias("t0"), F.round("t1", 1).alias("t1"))
    x = timeline.filter(F.col("kind") == kind).groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("_s")).join(videos, KEYS)
    segs = F.transform("_s", lambda s: F.struct(s["label"].alias("label"), s["t0"].alias("t0"), s["t1"].alias("t1")))
    goal = target(segments=segs, spans=F.transform("_s", lambda s: F.struct(s["t0"].alias("t0"), s["t1"].alias("t1"))), labels=F.transform("_s", lambda s: s["label"]))
    return item(x, "t2", kind, an.user_segmentation(grid(), F.col("duration_s"), f"{kind}s"), an.answer_segments(segs), goal)


@family
def duration_items(videos: DataFrame, every_s: float = 300.0) -> DataFrame:
    """Remaining minutes at each probe; only frames before it are shown.

    A small file of videos has probes by the million, so videos are dealt out before their probes are made.
    """
    spark = videos.sparkSession
    tasks = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    x = videos.repartition(tasks, *KEYS).select("*", F.posexplode(probe_times(F.col("duration_s"), every_s)).alias("_i", "_t"))
    left = (F.col("duration_s") - F.col("_t")) / 60.0
    w = (F.lit(0.0), F.col("_t"))
    return item(x, "t3", "rsd", an.user_rsd(grid(), F.col("_t")), an.answer_minutes(left), target(minutes=F.round(left, 2)), None, w, F.round("_t", 1), F.col("_i") + 1)


@family
def detection_items(videos: DataFrame, timeline: DataFrame, kind: str = "step", n_windows: int = 3, size_s: float = 300.0, seed: int = 0) -> DataFrame:
    """Labels active in drawn windows."""
    room = F.greatest(F.lit(0.0), F.col("duration_s") - size_s)
    share = F.conv(F.substring(draw(seed, F.lit("window"), F.col("video_id"), F.col("window_id").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    w = videos.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_windows))).alias("window_id")).withColumn("w0", F.round(room * share, 1))
    w = w.withColumn("w1", F.least(F.col("duration_s"), F.col("w0") + size_s))
    own = timeline.filter(F.col("kind") == kind)
    x = active_labels(w.join(own.select(*KEYS).distinct(), KEYS, "left_semi"), own, KEYS, "window_id")
    win = (F.col("w0"), F.col("w1"))
    return item(x, "t4", f"{kind}s", an.user_detection(grid(), F.col("duration_s"), *win, f"{kind}s"), an.answer_labels(F.col("labels")), target(labels=F.col("labels"), window=F.array(*win)), None, win)


@family
def summary_items(videos: DataFrame, timeline: DataFrame, seed: int = 0) -> DataFrame:
    """A drawn phase to the end of the second one after it, as a clipped timeline in words."""
    w = Window.partitionBy(*KEYS).orderBy("run_id")
    every = Window.partitionBy(*KEYS)
    p = timeline.filter("kind = 'phase'")
    ends = F.coalesce(F.lead("t1", 2).over(w), F.last("t1").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = p.select(*KEYS, F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(every).alias("n"), F.col("t0").alias("w0"), ends.alias("w1"))
    starts = starts.filter(F.col("k") - 1 == pick(F.col("n") - 1, seed, F.lit("summary"), F.col("video_id"))).select(*KEYS, "w0", "w1")
    x = starts.join(p, KEYS).filter(overlap(F.col("t0"), F.col("t1"), F.col("w0"), F.col("w1")) > 0)
    row = F.struct("run_id", "label", F.round(F.greatest("t0", "w0"), 1).alias("t0"), F.round(F.least("t1", "w1"), 1).alias("t1"))
    x = x.groupBy(*KEYS, "w0", "w1").agg(F.array_sort(F.collect_list(row)).alias("_s")).join(videos, KEYS)
    line = F.transform("_s", lambda s: F.struct(s["label"].alias("label"), s["t0"].alias("t0"), s["t1"].alias("t1")))
    text = F.concat(F.array_join(F.transform(line, lambda s: F.concat(s["label"], F.lit(" ("), an.whole(s["t0"]), F.lit("-"), an.whole(s["t1"]), F.lit(" s)"))), "; "), F.lit("."))
    win = (F.col("w0"), F.col("w1"))
    return item(x, "t6", "interval", an.user_summary(grid(), F.col("duration_s"), *win), an.answer_text(text), target(text=text, timeline=line), None, win)


@family
def qa_items(videos: DataFrame, timeline: DataFrame, seed: int = 0) -> DataFrame:
    """Order of the first two phases, length of a drawn one, and uses of the first action's tool."""
    w = Window.partitionBy(*KEYS)
    p = timeline.filter("kind = 'phase'").select(*KEYS, "label", "t0", "t1", F.row_number().over(w.orderBy("run_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"), F.lead("label").over(w.orderBy("run_id")).alias("then"))
    p = p.filter("n >= 2").join(videos, KEYS)
    order = p.filter("k = 1")
    q = F.concat(F.lit("Which comes first, the "), F.col("label"), F.lit(" or the "), F.col("then"), F.lit("?"))
    out = item(order, "t5", "ordering", an.user_qa(grid(), F.col("duration_s"), q), an.answer_text(F.col("label")), target(text=F.col("label"), answer=F.col("label")), q)
    one = p.filter(F.col("k") - 1 == pick(F.col("n"), seed, F.lit("duration"), F.col("video_id")))
    minutes = (F.col("t1") - F.col("t0")) / 60.0
    shown = F.format_string("%.1f", F.round(minutes, 1))
    q = F.concat(F.lit("How many minutes does the "), F.col("label"), F.lit(" last?"))
    out = out.unionByName(item(one, "t5", "duration", an.user_qa(grid(), F.col("duration_s"), q), an.answer_text(shown), target(text=shown, answer=shown, minutes=F.round(minutes, 2)), q))
    c = tool_counts(timeline.filter("kind = 'action'"), KEYS).join(videos, KEYS)
    q = F.concat(F.lit("How many times is the "), F.col("tool"), F.lit(" used?"))
    n = F.col("uses").cast("string")
    return out.unionByName(item(c, "t5", "counting", an.user_qa(grid(), F.col("duration_s"), q), an.answer_text(n), target(text=n, answer=n, count=F.col("uses").cast("int")), q))


def tool_counts(actions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tool (first word of the first action), uses: runs that share it."""
    word = F.split_part(F.col("label"), F.lit(" "), F.lit(1))
    x = actions.select(*keys, "run_id", word.alias("tool"))
    first = x.groupBy(*keys).agg(F.min_by("tool", "run_id").alias("tool"))
    return x.join(first, [*keys, "tool"]).groupBy(*keys, "tool").agg(F.count(F.lit(1)).alias("uses"))


@family
def unanswerable_items(videos: DataFrame, hard_edges: list[tuple[str, str]], seed: int = 0) -> DataFrame:
    """Per video a question about an absent event and one that reverses a drawn hard edge (a before b)."""
    which = pick(F.lit(len(ABSENT)), seed, F.lit("absent"), F.col("video_id"))
    q = F.concat(F.lit("When is "), F.get(F.array(*[F.lit(x) for x in ABSENT]), which), F.lit(" performed?"))
    gone = an.answer_spans(F.array().cast(an.SPANS), abstain=True)
    out = item(videos, "t1", "unanswerable", an.user_grounding(grid(), F.col("duration_s"), q), gone, target(abstain=F.lit(True)), q)
    if not hard_edges:
        return out
    edge = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in hard_edges]), pick(F.lit(len(hard_edges)), seed, F.lit("edge"), F.col("video_id")))
    q = F.concat(F.lit("After the "), edge["b"], F.lit(", when is the "), edge["a"], F.lit(" performed?"))
    return out.unionByName(item(videos, "t1", "contradiction", an.user_grounding(grid(), F.col("duration_s"), q), gone, target(abstain=F.lit(True)), q))


def build(videos: DataFrame, timeline: DataFrame, hard_edges: list[tuple[str, str]] = (), steps: DataFrame | None = None, families: tuple[str, ...] | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """All items of the families (t1 to t6), in a drawn order if limited, with ids per video."""
    parts = [
        *[grounding_items.drafts(videos, timeline, k, multi=k != "step", least_s=2.0 if k == "action" else 0.0) for k in ("phase", "step", "action")],
        relative_items.drafts(videos, timeline, seed),
        *([cross_scale_items.drafts(videos, timeline, steps)] if steps is not None else []),
        unanswerable_items.drafts(videos, list(hard_edges), seed),
        segmentation_items.drafts(videos, timeline, "phase"),
        segmentation_items.drafts(videos, timeline, "step"),
        detection_items.drafts(videos, timeline, "step", seed=seed),
        qa_items.drafts(videos, timeline, seed),
        summary_items.drafts(videos, timeline, seed),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # prompts of a video differ in their frames only where windows do, and those by their first time; probes count themselves
    order = Window.partitionBy(*KEYS, "task").orderBy("sub_type", "probe_t_s", an.format_ts(F.col("_a")), "_user")
    out = out.withColumn("_k", F.row_number().over(order).cast("long")).unionByName(duration_items.drafts(videos))
    if families:
        out = out.filter(F.col("task").isin(*families))
    out = out.withColumn("id", F.format_string("%s-%s-%s-%06d", "dataset", "video_id", "task", "_k"))
    return finished(out.orderBy(draw(seed, F.col("id")), "id").limit(limit) if limit is not None else out)


def histogram(items: DataFrame) -> DataFrame:
    return items.groupBy("task", "sub_type").agg(F.count(F.lit(1)).alias("n"))
