"""Procedure graphs: precedence edges, their closure, violations, and precedence mined from timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.operators.store import dropped, stored


CLOSURE = """WITH RECURSIVE reach(a, b, d) AS (
    SELECT DISTINCT a, b, 1 FROM {edges}
    UNION ALL
    SELECT DISTINCT reach.a, e.b, d + 1 FROM reach JOIN {edges} AS e ON reach.b = e.a
    WHERE d < (SELECT count(DISTINCT a) FROM {edges})
) SELECT DISTINCT a, b FROM reach"""


def closure(edges: DataFrame) -> DataFrame:
    """(a, b): b is reachable from a; nodes on a cycle reach themselves. One plan, by recursive SQL.

    A shortest path leaves no node twice, so paths of as many edges as there are nodes with one are enough; a level
    keeps each pair once. For procedure graphs, which are parameters of tens or hundreds of nodes: every level is a
    join, and the session's limits of recursion (100 levels, a million rows a level) hold. Larger graphs take
    ``closure_by_doubling``.
    """
    x = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    return edges.sparkSession.sql(CLOSURE, edges=x.coalesce(1))


def closure_by_doubling(edges: DataFrame) -> DataFrame:
    """``closure`` of a graph of any size: each round joins paths of up to 2^k edges with themselves.

    The rounds grow with the logarithm of the depth; each is written, and the one before it deleted.
    """
    paths = stored(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "paths")
    known = paths.count()
    while True:
        hop = paths.select(F.col("a").alias("b"), F.col("b").alias("c"))
        more = stored(paths.union(paths.join(hop, "b").select("a", F.col("c").alias("b"))).distinct(), "paths")
        now = more.count()
        dropped(paths)
        if now == known:
            return more
        paths, known = more, now


def must_precede(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with a boolean must_precede."""
    known = reach.select("a", "b").distinct().withColumn("_k", F.lit(True))
    return pairs.join(known, ["a", "b"], "left").withColumn("must_precede", F.coalesce("_k", F.lit(False))).drop("_k")


def violations(timeline: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of runs i before j whose labels must come the other way round: keys, first, second, i, j.

    Runs are paired only where the closure links their labels: the join goes through the closure, keyed by video
    and label, not through all pairs of a video's runs.
    """
    order = Window.partitionBy(*keys).orderBy("t0", "run_id")
    runs = timeline.select(*keys, "label", F.row_number().over(order).alias("pos"))
    rule = reach.select(F.col("a").alias("second"), F.col("b").alias("first")).distinct()
    early = runs.select(*keys, F.col("label").alias("first"), F.col("pos").alias("i")).join(rule, "first")
    late = runs.select(*keys, F.col("label").alias("second"), F.col("pos").alias("j"))
    return early.join(late, [*keys, "second"]).filter("i < j").select(*keys, "first", "second", "i", "j")


def violation_counts(timeline: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_violations, from counts per label, without listing pairs: 0 for videos in order.

    A run marks each rule that its label is in, as the later or the earlier side; rules are a row for each label, which
    is broadcast as the graph is a parameter. All windows and the sum share the one exchange by ``keys``.
    """
    order = Window.partitionBy(*keys).orderBy("t0", "run_id")
    runs = timeline.select(*keys, F.col("label").alias("_l"), F.row_number().over(order).alias("pos"))
    rule = reach.select(F.col("a").alias("label"), F.col("b").alias("before")).distinct()
    side = lambda own, late: rule.select(F.col(own).alias("_own"), F.struct("label", "before", F.lit(late).alias("is_late")).alias("_m"))
    roles = side("label", 1).union(side("before", 0)).groupBy("_own").agg(F.collect_list("_m").alias("_ms"))
    marks = runs.join(F.broadcast(roles), F.col("_l") == F.col("_own"), "left").select(*keys, "pos", F.explode_outer("_ms").alias("_m")).select(*keys, "pos", "_m.*")
    seen = Window.partitionBy(*keys, "label", "before").orderBy("pos", "is_late").rowsBetween(Window.unboundedPreceding, -1)
    early = F.coalesce(F.sum(F.when(F.col("is_late") == 0, 1).otherwise(0)).over(seen), F.lit(0))
    counts = F.when((F.col("is_late") == 1) & (F.col("label") != F.col("before")), early).otherwise(0)
    return marks.withColumn("_n", counts).groupBy(*keys).agg(F.sum("_n").cast("long").alias("n_violations"))


def forbidden_next(emitted: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """Labels that may not come after what keys have emitted, since they must precede one of it: keys, label."""
    rule = reach.select(F.col("b").alias("label"), F.col("a").alias("forbidden"))
    return emitted.select(*keys, "label").distinct().join(rule, "label").select(*keys, F.col("forbidden").alias("label")).distinct()


def step_phase_consistent(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """pairs (step, phase, ...) with consistent: the step's parent is the phase, or it has none."""
    parents = steps.select(F.col("id").alias("step"), F.col("parent_phase").alias("_p"))
    return pairs.join(parents, "step", "left").withColumn("consistent", F.col("_p").isNull() | (F.col("_p") == F.col("phase"))).drop("_p")


def mine_precedence(timeline: DataFrame, keys: list[str], hard: float = 0.95, support: int = 3) -> DataFrame:
    """a, b, n (videos with both), share with a before b by first start, and whether that makes the edge hard."""
    first = timeline.groupBy(*keys, "label").agg(F.min("t0").alias("t"))
    a = first.select(*keys, F.col("label").alias("a"), F.col("t").alias("ta"))
    b = first.select(*keys, F.col("label").alias("b"), F.col("t").alias("tb"))
    pairs = a.join(b, keys).filter("a <> b")
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ta") < F.col("tb")).cast("double")).alias("share"))
    return out.withColumn("hard", (F.col("share") >= hard) & (F.col("n") >= support))


def mine_parents(co_occurrence: DataFrame, purity: float = 0.9) -> DataFrame:
    """(step, phase, weight) -> step, parent_phase (null below the purity), purity."""
    total = co_occurrence.groupBy("step", "phase").agg(F.sum("weight").alias("w"))
    per = total.groupBy("step").agg(F.max_by("phase", F.struct("w", "phase")).alias("_p"), F.max("w").alias("_m"), F.sum("w").alias("_t"))
    share = F.col("_m") / F.col("_t")
    return per.select("step", F.when(share >= purity, F.col("_p")).alias("parent_phase"), share.alias("purity"))
