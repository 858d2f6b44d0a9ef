"""Driver queries on procedure graphs, order violations, mined precedence and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.operators import graph as g
from chronoleaf.operators import metrics as m
from chronoleaf.operators import timeline as tl
from chronoleaf.plans.base import EDGE_SQL, EDGES, KEYS, SQL, TIOU, runs, stored, table
from chronoleaf.plans.language import KIND, shown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "a string, b string")


CLOSURE = EDGE_SQL + ", c(a, b, d) AS (SELECT a, b, 1 FROM edges UNION ALL SELECT c.a, e.b, d + 1 FROM c JOIN edges e ON c.b = e.a WHERE d < 10), reach AS (SELECT DISTINCT a, b FROM c)"
WITH_CLOSURE = SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + CLOSURE


@query("WITH RECURSIVE " + CLOSURE + " SELECT a, b FROM reach")
def graph_closure(spark: SparkSession, sf: str) -> DataFrame:
    return g.closure(edges(spark))


@query("WITH RECURSIVE " + CLOSURE + ", n(x) AS (SELECT DISTINCT event_type FROM events) SELECT p.x AS a, q.x AS b, EXISTS (SELECT 1 FROM reach WHERE a = p.x AND b = q.x) AS must_precede FROM n p, n q")
def must_precede(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").select("event_type").distinct()
    pairs = n.agg(F.array_sort(F.collect_set("event_type")).alias("s")).select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b"))
    return g.must_precede(pairs, g.closure(edges(spark)))


VIOL = WITH_CLOSURE + ", o AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY t0, run_id) AS pos FROM runs), v AS (SELECT x.user_id, x.session, x.label AS first, y.label AS second, x.pos AS i, y.pos AS j FROM o x JOIN o y ON x.user_id = y.user_id AND x.session = y.session AND x.pos < y.pos JOIN reach ON a = y.label AND b = x.label)"


@query(VIOL + " SELECT user_id, session, first, second, i::INT AS i, j::INT AS j FROM v")
def order_violations(spark: SparkSession, sf: str) -> DataFrame:
    return g.violations(runs(spark, sf), g.closure(edges(spark)), KEYS)


@query(VIOL + ", n AS (SELECT user_id, session, count(*) AS n FROM v GROUP BY ALL) SELECT user_id, session, coalesce(n, 0) AS n_violations FROM procs LEFT JOIN n USING (user_id, session)")
def violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return g.violation_counts(runs(spark, sf), g.closure(edges(spark)), KEYS)


@query(VIOL + " SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.user_id = p.user_id AND v.session = p.session) THEN 0e0 ELSE 1e0 END), 6) AS temporal_consistency FROM procs p")
def temporal_consistency(spark: SparkSession, sf: str) -> DataFrame:
    x = g.violation_counts(runs(spark, sf), g.closure(edges(spark)), KEYS)
    return x.agg(F.round(F.avg((F.col("n_violations") == 0).cast("double")), 6).alias("temporal_consistency"))


@query(WITH_CLOSURE + " SELECT DISTINCT user_id, session, reach.a AS label FROM runs JOIN reach ON reach.b = runs.label")
def forbidden_next(spark: SparkSession, sf: str) -> DataFrame:
    return g.forbidden_next(runs(spark, sf), g.closure(edges(spark)), KEYS)



@query("SELECT c_custkey, coalesce(CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE n_regionkey END = c_custkey % 5, true) AS consistent FROM customer JOIN nation ON c_nationkey = n_nationkey")
def step_phase_consistency(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("parent_phase"))
    pairs = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("step"), (F.col("c_custkey") % 5).alias("phase"))
    return g.step_phase_consistent(pairs, steps).select("c_custkey", "consistent")


FIRST = ", f AS (SELECT user_id, session, label, min(t0) AS t FROM runs GROUP BY ALL)"


@query(SQL + FIRST + ", p AS (SELECT x.label AS a, y.label AS b, count(*) AS n, avg((x.t < y.t)::INT) AS share FROM f x JOIN f y ON x.user_id = y.user_id AND x.session = y.session AND x.label <> y.label GROUP BY ALL) SELECT a, b, n, round(share, 6) AS share, share >= 0.5 AND n >= 3 AS hard FROM p")
def precedence_mining(spark: SparkSession, sf: str) -> DataFrame:
    x = g.mine_precedence(runs(spark, sf), KEYS, 0.5)
    return x.select("a", "b", "n", F.round("share", 6).alias("share"), "hard")


@query("WITH w AS (SELECT c_nationkey AS step, c_mktsegment AS phase, count(*) AS w FROM customer GROUP BY ALL), b AS (SELECT step, phase, w, sum(w) OVER (PARTITION BY step) AS t, row_number() OVER (PARTITION BY step ORDER BY w DESC, phase DESC) AS k FROM w) SELECT step, CASE WHEN w::DOUBLE / t >= 0.25 THEN phase END AS parent_phase, round(w::DOUBLE / t, 6) AS purity FROM b WHERE k = 1")
def parent_mining(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "customer").select(F.col("c_nationkey").alias("step"), F.col("c_mktsegment").alias("phase"), F.lit(1).alias("weight"))
    return g.mine_parents(x, 0.25).select("step", "parent_phase", F.round("purity", 6).alias("purity"))


Q = {"p0": "round(greatest(0e0, p0), 1)", "p1": "round(greatest(0e0, p1), 1)"}
IOU = TIOU.format(Q["p0"], Q["p1"], "t0", "t1")
SHAPED = f"CASE WHEN {IOU} > 0 THEN {IOU} ELSE -0.5e0 * least(1e0, abs(({Q['p0']} + {Q['p1']}) / 2 - (t0 + t1) / 2) / greatest(dur, 1e-6)) END"


@query(VIOL + f""", n AS (SELECT user_id, session, count(*) AS n FROM v GROUP BY ALL),
x AS (SELECT user_id, session, run_id, {KIND} AS kind, run_id % 10 = 0 AS ab, {SHAPED} AS shaped, 0e0 - least(1e0, 0.34e0 * coalesce(n, 0)) AS r_order FROM runs JOIN procs USING (user_id, session) LEFT JOIN n USING (user_id, session)),
y AS (SELECT *, CASE WHEN kind <> 'bad' THEN 1e0 ELSE 0e0 END AS r_format, CASE WHEN ab THEN CASE WHEN kind = 'abstain' THEN 1e0 ELSE -1e0 END WHEN kind = 'abstain' THEN -0.2e0 WHEN kind = 'span' THEN shaped ELSE 0e0 END AS r_tiou, CASE WHEN ab THEN CASE WHEN kind = 'abstain' THEN 1e0 ELSE -1e0 END ELSE 0e0 END AS r_abstain FROM x)
SELECT user_id, session, run_id, kind, round(r_format + r_tiou + 0.5e0 * r_order + 0.5e0 * r_abstain, 6) AS reward, round(r_tiou, 6) AS r_tiou, round(r_order, 6) AS r_order, r_abstain FROM y""")
def reward_terms(spark: SparkSession, sf: str) -> DataFrame:
    x = shown(spark, sf)  # its windows, the counts and the durations share one exchange by session
    n = g.violation_counts(x.select(*KEYS, "run_id", "label", "t0", "t1"), g.closure(edges(spark)), KEYS)
    x = x.withColumn("duration_s", F.max("t1").over(Window.partitionBy(*KEYS))).join(n, KEYS)
    r = m.reward(an.parse_answer(F.col("text")), F.array(F.struct("t0", "t1")), F.col("run_id") % 10 == 0, F.col("duration_s"), F.col("n_violations"))
    x = x.select(*KEYS, "run_id", r.alias("r"))
    return x.select(*KEYS, "run_id", F.col("r.kind").alias("kind"), F.round("r.reward", 6).alias("reward"), F.round("r.r_tiou", 6).alias("r_tiou"), F.round("r.r_order", 6).alias("r_order"), F.col("r.r_abstain").alias("r_abstain"))
