"""Mixing sources to target weights by repetition rates.

Tokens are aggregated per source, each source gets a target and so a rate = target / source size, and a
document is emitted floor(rate) times plus one more time when a draw seeded by its doc_id is below the
fraction. Only one row per source is aggregated and ranked; documents are joined to it by source, and the
optimizer broadcasts that side when its measured size allows, or splits the hot source's partitions.

Defined cases: a null text has size 0; a null source is a source of its own that ranks last; a null doc_id
draws as the text "null"; rows that repeat a doc_id share its draw, so a rerun always emits the same rows;
an empty table gives an empty table; other columns of the input are ignored by ``mix_plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.llm.common import n_words, written

#: No document is emitted more often than this.
MAX_RATE = 3
SEED = 7


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of seed and doc_id."""
    key = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(per_source: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, w) -> the same with target and rate.

    Targets share the sum of all sizes by weight w, none above max_rate * source_size. Sources are capped in
    the order of source_size / w, so a running sum finds in one pass where the reshared excess settles.
    """
    dec = "decimal(38,0)"
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("rank").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cap = F.col("source_size").cast(dec) * max_rate
    x = per_source.select("*", cap.cast(dec).alias("cap"))
    x = x.select(
        "*",
        (F.sum(F.col("source_size")).over(every).cast(dec) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(dec)).alias("left_size"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    x = x.withColumn("capped", F.col("cap").cast("double") * F.col("left_w") <= F.col("left_size").cast("double") * F.col("w"))
    x = x.select(
        "*",
        (F.sum("source_size").over(every).cast(dec) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(0))).over(every).cast(dec)).alias("rest"),
        F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("w"))).over(every).alias("rest_w"),
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest").cast("double") * F.col("w") / F.col("rest_w"))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.lit(float(max_rate))).otherwise(target / F.col("source_size"))
    return x.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def source_weights(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source with its size, its rank by code point (null last) and its weight, which cycles by rank."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    place = F.pmod(F.col("rank") - 1, F.lit(len(cycle)))
    return ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in cycle]), (place + 1).cast("int")).cast("long"))


def with_rates(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """Joins each row of ``sized`` (doc_id, source, size, ...) to its source's figures and adds copies."""
    t = targets(source_weights(sized, cycle), max_rate).withColumnRenamed("source", "t_source")
    joined = sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    whole = F.floor(F.col("rate"))
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", (whole + extra).cast("long"))


def mix_plan(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of each row of ``docs``."""
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return with_rates(sized, **kw)


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = rows.select("doc_id", "source", "size")
    t = targets(source_weights(sized, kw.get("cycle", (1, 2, 3))), kw.get("max_rate", MAX_RATE))
    t = written(t.withColumnRenamed("source", "t_source"), "mix-targets")
    whole = F.floor(F.col("rate"))
    extra = (draw(F.col("doc_id"), kw.get("seed", SEED)) < F.col("rate") - whole).cast("long")
    taken = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("copies", (whole + extra).cast("int"))
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
