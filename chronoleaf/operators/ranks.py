"""Ranks and running sums over one order of all rows, or of a key that holds most of them, without one task for it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.operators.store import stored


def ranked(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), rank: str = "rank", sums: Mapping[str, str] | None = None, count: str | None = None) -> DataFrame:
    """Adds rank (from 1) by ``order`` within ``by``; for name, column in sums the running sum of column; count: rows of the key.

    Rows are dealt out by quantile ranges of (by, order) and sorted there. A row's place is its place in its range plus
    the rows of its key in the ranges before; only one row for each range and key is ordered again. ``order`` should
    end in a column that tells rows apart, as a range ends between different values only.
    The ranged rows are written first, so that counts and ranks see the same ranges. Nulls of a sum count as 0.
    """
    spark, sums = df.sparkSession, dict(sums or {})
    keys = [*by, *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    x = x.withColumn("_range", F.shiftright("_row", 33))
    per = x.groupBy(*by, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_sum_{name}") for name, c in sums.items()])
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), (before("_n") - F.col("_first")).alias("_shift"), *[before(f"_sum_{name}").alias(f"_before_{name}") for name in sums], F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    x = x.join(per if by else F.broadcast(per), same)
    out = {rank: (F.col("_shift") + F.col("_row") + 1).cast("long")}
    inner = Window.partitionBy(*by, "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    for name, c in sums.items():
        out[name] = F.col(f"_before_{name}") + F.sum(F.coalesce(F.col(c), F.lit(0))).over(inner)
    if count:
        out[count] = F.col("_all")
    return x.withColumns(out).select(*df.columns, *[c for c in out if c not in df.columns])
