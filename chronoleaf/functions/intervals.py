"""Column expressions on half-open intervals [t0, t1) in seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges, in minutes, of the length buckets.
LENGTH_EDGES = (30, 60, 120)
# Words of a question that route it to retrieval; the short list is the configured one.
TOOL_WORDS = ("instrument", "tool", "stapler", "clip", "grasper", "scissors", "hook", "bipolar", "needle", "suction")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part; negative where there is a gap."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def tiou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Temporal intersection over union, 0 where the union is empty."""
    inter = F.greatest(F.lit(0.0), overlap(a0, a1, b0, b1))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def hull_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the hull of both intervals."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), overlap(a0, a1, b0, b1)) / hull).otherwise(F.lit(0.0))


def span_iou(p: Column, g: Column) -> Column:
    """``tiou`` of two structs (t0, t1)."""
    return tiou(p["t0"], p["t1"], g["t0"], g["t1"])


def center_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.abs((a0 + a1) / 2 - (b0 + b1) / 2)


def best_iou(p: Column, spans: Column) -> Column:
    """Greatest ``tiou`` of a span against an array of spans, 0 for none."""
    return F.coalesce(F.array_max(F.transform(spans, lambda g: span_iou(p, g))), F.lit(0.0))


def greedy_matches(preds: Column, gts: Column) -> Column:
    """For each true span in order: (iou, t0, t1) of the best prediction not used yet, ties by place.

    Where none is left, iou is 0 and the span is the start of the true one.
    """
    kind = "struct<used:array<int>,out:array<struct<iou:double,t0:double,t1:double>>>"
    start = F.from_json(F.lit('{"used":[],"out":[]}'), kind)

    def step(a: Column, g: Column) -> Column:
        scored = F.transform(preds, lambda p, i: F.struct(F.when(F.array_contains(a["used"], i), F.lit(-1.0)).otherwise(span_iou(p, g)).alias("iou"), (-i).alias("o"), p["t0"].alias("t0"), p["t1"].alias("t1")))
        best = F.array_max(scored)
        free = F.coalesce(best["iou"], F.lit(-1.0)) >= 0
        row = F.when(free, F.struct(best["iou"].alias("iou"), best["t0"].alias("t0"), best["t1"].alias("t1"))).otherwise(F.struct(F.lit(0.0).alias("iou"), g["t0"].alias("t0"), g["t0"].alias("t1")))
        used = F.when(free, F.array_append(a["used"], -best["o"])).otherwise(a["used"])
        return F.struct(used.alias("used"), F.array_append(a["out"], row.cast("struct<iou:double,t0:double,t1:double>")).alias("out")).cast(kind)

    return F.aggregate(gts, start, step, lambda a: a["out"])


def mean_best_iou(preds: Column, gts: Column) -> Column:
    """Mean over true spans of their greedy matches, 0 for no true span."""
    matched = greedy_matches(preds, gts)
    total = F.aggregate(matched, F.lit(0.0), lambda a, m: a + m["iou"])
    return F.when(F.size(gts) > 0, total / F.size(gts)).otherwise(F.lit(0.0))


def length_bucket(duration_s: Column, edges: Sequence[int] = LENGTH_EDGES) -> Column:
    """Half-open buckets named "<30min", "30-60min", ..., ">120min"."""
    minutes, low = duration_s / 60.0, None
    out = None
    for e in edges:
        name = f"<{e}min" if low is None else f"{low}-{e}min"
        out = F.when(minutes < e, name) if out is None else out.when(minutes < e, name)
        low = e
    return out.otherwise(f">{edges[-1]}min")


def regime(duration_s: Column, query: Column, keywords: Sequence[str] = TOOL_WORDS, short_s: float = 2700.0, long_s: float = 7200.0) -> Column:
    """Route of a question: short, retrieve (very long, or about a tool) or hier."""
    named = F.lit(False)
    for k in keywords:
        named = named | F.contains(F.lower(F.coalesce(query, F.lit(""))), F.lit(k))
    return F.when(duration_s < short_s, "short").when((duration_s >= long_s) | named, "retrieve").otherwise("hier")


def tenths(x: Column) -> Column:
    """The tenths of a number from 0: ten times it, its halves upward, as SQL engines round; ``F.round`` goes by its shortest decimal form.

    Both differ where ten times a number just below a half is that half.
    """
    y = x * 10
    return F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)


def round1(x: Column) -> Column:
    """A number to 1 decimal by ``tenths``; those without decimals, as large ones, stay."""
    return F.when(F.abs(x) < 1e15, F.when(x < 0, -tenths(-x)).otherwise(tenths(x)) / 10.0).otherwise(x)


def sample_times(t0: Column, t1: Column, n: int) -> Column:
    """n points from t0 to t1, both included, to 1 decimal; one point where the span is empty or n is 1."""
    if n <= 1:
        return F.array(round1(t0))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: round1(t0 + i * ((t1 - t0) / (n - 1))))
    return F.when(t1 > t0, grid).otherwise(F.array(round1(t0)))


def probe_times(duration_s: Column, every_s: float = 300.0) -> Column:
    """every_s, 2 every_s, ... below the duration."""
    n = (F.ceil(duration_s / every_s) - 1).cast("int")
    grid = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i * F.lit(float(every_s)))
    return F.when(n >= 1, grid).otherwise(F.array().cast("array<double>"))


def micro_batches(n: Column, chunk: int) -> Column:
    """Half-open index ranges that cover 0..n in chunks."""
    last = F.ceil(n / chunk).cast("int") - 1
    parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct((i * chunk).alias("start"), F.least((i + 1) * chunk, n.cast("int")).alias("stop")))
    return F.when(n > 0, parts).otherwise(F.filter(parts, lambda _: F.lit(False)))


def next_window(t0: Column, t1: Column, pad_s: Column | float, duration_s: Column) -> Column:
    """A window widened by pad_s on both sides and clamped to the video, as a struct (t0, t1)."""
    pad = pad_s if isinstance(pad_s, Column) else F.lit(pad_s)
    return F.struct(F.greatest(F.lit(0.0), t0 - pad).alias("t0"), F.least(duration_s, t1 + pad).alias("t1"))


def clip_windows(duration_s: Column, size_s: float = 30.0, stride_s: float = 15.0) -> Column:
    """Overlapping windows from 0 that start below the duration, clamped to it."""
    n = F.ceil(duration_s / stride_s).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * F.lit(float(stride_s))).alias("t0"), F.least(i * F.lit(float(stride_s)) + size_s, duration_s).alias("t1")))
    return F.when(n >= 1, made).otherwise(F.filter(made, lambda _: F.lit(False)))


def vision_tokens(n_frames: Column, per_frame: int, stride: int = 1, pool: int = 1) -> Column:
    """Frames kept by a stride times tokens of a pooled frame, at least one each."""
    return (F.ceil(n_frames / stride) * max(1, per_frame // (pool * pool))).cast("long")


def context_length(n_vision: Column, n_text: Column) -> Column:
    return (n_vision + n_text).cast("long")


def tokens_per_video(frames_by_regime: Column, per_frame: int, stride: int = 1, pool: int = 1) -> Column:
    """A map of regime to frames as one of regime to tokens."""
    return F.transform_values(frames_by_regime, lambda _, n: vision_tokens(n, per_frame, stride, pool))
