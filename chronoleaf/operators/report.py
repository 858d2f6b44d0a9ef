"""Result cells to long rows, pivots by length bucket, and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The result table's columns in order.
RESULT_COLUMNS = [
    "backend",
    "method",
    "regime",
    "ckpt",
    "dataset",
    "domain",
    "center",
    "task",
    "sub_type",
    "split",
    "in_domain",
    "len_bucket",
    "r1@0.3",
    "r1@0.5",
    "r1@0.7",
    "r5@0.5",
    "miou",
    "frame_acc",
    "segF1@10",
    "segF1@25",
    "segF1@50",
    "edit",
    "step_phase_consistency",
    "rsd_mae_min",
    "rsd_within5",
    "det_mAP",
    "qa_em",
    "qa_judge",
    "temporal_consistency",
    "summ_judge",
    "ece",
    "ece_adapt",
    "T",
    "aurc",
    "risk@0.8cov",
    "confwrong_impossible",
    "abstain_f1",
    "conf_auroc",
    "n_frames",
    "n_vis_tokens",
    "ctx_len",
    "prefill_ms",
    "decode_ms",
    "peak_vram_gb",
    "gpu_s_per_q",
    "n_items",
    "ci_lo",
    "ci_hi",
    "git_sha",
    "cfg_hash",
    "seed",
    "timestamp",
]
DESCRIPTORS = RESULT_COLUMNS[:11]
ALIASES = {"rsd_mae_min": "mae_min", "rsd_within5": "within5", "n_items": "n"}
EFFICIENCY = RESULT_COLUMNS[RESULT_COLUMNS.index("n_frames") : RESULT_COLUMNS.index("n_items")]
PROVENANCE = ("git_sha", "cfg_hash", "seed", "timestamp")
BUCKETS = ("overall", "<30min", "30-60min", "60-120min", ">120min")


def flatten(cells: DataFrame) -> DataFrame:
    """cells (descriptors, metrics map, by_length map of maps, provenance map) -> one row per bucket with RESULT_COLUMNS.

    ci, where cells have it, maps a bucket to its interval of two numbers, which goes to ci_lo and ci_hi.
    """
    every = F.map_concat(F.create_map(F.lit("overall"), F.col("metrics")), F.coalesce("by_length", F.create_map().cast("map<string,map<string,double>>")))
    x = cells.select("*", F.explode(every).alias("len_bucket", "_m"))
    metrics = [c for c in RESULT_COLUMNS if c not in DESCRIPTORS and c not in PROVENANCE and c != "len_bucket"]
    value = lambda c: F.coalesce(F.try_element_at("_m", F.lit(c)), F.try_element_at("_m", F.lit(ALIASES[c]))) if c in ALIASES else F.try_element_at("_m", F.lit(c))
    by = {c: F.col(c) if c in cells.columns else F.lit(None).cast("string") for c in DESCRIPTORS}
    pair = F.try_element_at("ci", F.col("len_bucket")) if "ci" in cells.columns else F.lit(None).cast("array<double>")
    ci = {f"ci_{end}": F.coalesce(F.when(F.size(pair) == 2, pair[i]), value(f"ci_{end}")) for i, end in enumerate(("lo", "hi"))}
    by |= {c: value(c) for c in metrics} | ci | {c: F.try_element_at("provenance", F.lit(c)) for c in PROVENANCE} | {"len_bucket": F.col("len_bucket")}
    return x.select(*[by[c].alias(c) for c in RESULT_COLUMNS])


def long_metrics(cells: DataFrame) -> DataFrame:
    """The same as one row per metric, so that no metric outside the fixed columns is lost."""
    every = F.map_concat(F.create_map(F.lit("overall"), F.col("metrics")), F.coalesce("by_length", F.create_map().cast("map<string,map<string,double>>")))
    keep = [c for c in DESCRIPTORS if c in cells.columns]
    return cells.select(*keep, F.explode(every).alias("len_bucket", "_m")).select(*keep, "len_bucket", F.explode("_m").alias("metric", "value"))


def pivot_by_length(rows: DataFrame, metric: str, keys: list[str], order: str | None = None) -> DataFrame:
    """Keys by length bucket in their canonical order; of rows that repeat a cell, the last by ``order`` counts.

    Without an order that is the row's timestamp, and of rows of one timestamp the greatest value.
    """
    v = F.col(f"`{metric}`")
    value = F.max_by(v, F.struct(F.col(order or "timestamp"), v))
    return rows.groupBy(*keys).pivot("len_bucket", list(BUCKETS)).agg(value)


def pivot_efficiency(rows: DataFrame, keys: list[str]) -> DataFrame:
    some = F.lit(False)
    for c in EFFICIENCY:
        some = some | F.col(c).isNotNull()
    return rows.filter((F.col("len_bucket") == "overall") & some).select(*keys, *EFFICIENCY)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A pivot as a text table; it has a row per method, and more than ``most`` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write a file instead")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def build_pivots(rows: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The standard report: three metrics by length, and efficiency."""
    return {m: pivot_by_length(rows, m, keys) for m in ("r1@0.5", "miou", "frame_acc")} | {"efficiency": pivot_efficiency(rows, keys)}
