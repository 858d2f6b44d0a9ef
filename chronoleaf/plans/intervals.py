"""Driver queries on runs, intervals, windows, grounding, segmentation and remaining durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.functions import intervals as iv
from chronoleaf.operators import metrics as m
from chronoleaf.operators import timeline as tl
from chronoleaf.plans.base import BUCKET, KEYS, LABELS, SQL, TIOU, frames, predicted, procedures, runs, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


span = lambda a, b: F.array(F.struct(F.col(a).alias("t0"), F.col(b).alias("t1")))


@query(SQL + "SELECT user_id, session, run_id, label, round(t0, 6) AS t0, round(t1, 6) AS t1, n_frames FROM runs")
def runs_label_change(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).select("user_id", "session", "run_id", "label", r6("t0"), r6("t1"), "n_frames")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_returnflag AS label, l_orderkey AS o FROM lineitem),
i AS (SELECT *, o - row_number() OVER (PARTITION BY l_suppkey, label ORDER BY o) AS g FROM d)
SELECT l_suppkey, label, min(o) AS f0, max(o) + 1 AS f1 FROM i GROUP BY l_suppkey, label, g HAVING max(o) + 1 - min(o) >= 2""")
def runs_consecutive_min2(spark: SparkSession, sf: str) -> DataFrame:
    return tl.consecutive_runs(table(spark, sf, "lineitem"), ["l_suppkey"], "l_orderkey", "l_returnflag")


@query(SQL + "SELECT user_id, session, label, count(*) AS n_runs, min(run_id) AS first_run, round(min(t0), 6) AS first_t0 FROM runs GROUP BY user_id, session, label")
def runs_by_label(spark: SparkSession, sf: str) -> DataFrame:
    x = tl.runs_by_label(runs(spark, sf), KEYS)
    return x.select(*KEYS, "label", F.size("spans").cast("long").alias("n_runs"), "first_run", F.round(F.col("spans")[0]["t0"], 6).alias("first_t0"))


@query(SQL + f"SELECT user_id, session, run_id, round({TIOU.format('p0', 'p1', 't0', 't1')}, 6) AS iou, round(abs((p0 + p1) / 2 - (t0 + t1) / 2), 9) AS center_dist FROM runs")
def tiou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    x = predicted(runs(spark, sf))
    c = [F.col(n) for n in ("p0", "p1", "t0", "t1")]
    return x.select(*KEYS, "run_id", F.round(iv.tiou(*c), 6).alias("iou"), F.round(iv.center_distance(*c), 9).alias("center_dist"))


HITS = ", ".join(f"round(avg(CASE WHEN iou >= {t} THEN 1e0 ELSE 0e0 END), 6) AS r{k}_{int(t * 100)}" for k in (1, 5) for t in (0.3, 0.5, 0.7))


@query(SQL + f", x AS (SELECT {TIOU.format('p0', 'p1', 't0', 't1')} AS iou, {BUCKET.format('dur')} AS b FROM runs JOIN procs USING (user_id, session)) SELECT CASE WHEN grouping(b) = 1 THEN 'overall' ELSE b END AS len_bucket, {HITS}, round(avg(iou), 6) AS miou, count(*) AS n FROM x GROUP BY ROLLUP (b)")
def grounding_recall_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: recall at IoU thresholds and mean IoU by procedure length, and overall."""
    x = predicted(runs(spark, sf))
    x = x.join(tl.durations(x, KEYS), KEYS).select(span("p0", "p1").alias("pred_spans"), span("t0", "t1").alias("gt_spans"), "duration_s")
    out = m.grounding_report(x)
    return out.select("len_bucket", *[r6(c) for c in out.columns if c not in ("len_bucket", "n")], "n")


SCORE = TIOU.format("p[k].t0", "p[k].t1", "g[i + 1].t0", "g[i + 1].t1")


@query(SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", x AS (SELECT user_id, session, label, list({{'t0': p0, 't1': p1}} ORDER BY p0, p1) AS p, list({{'t0': t0, 't1': t1}} ORDER BY t0, t1) AS g FROM runs GROUP BY ALL),
r AS (SELECT user_id, session, label, p, g, 0 AS i, []::BIGINT[] AS used, 0e0 AS s FROM x UNION ALL SELECT user_id, session, label, p, g, i + 1, CASE WHEN b >= 0 THEN list_append(used, list_position(sc, b)) ELSE used END, s + greatest(b, 0) FROM (SELECT *, list_max(sc) AS b FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda k: CASE WHEN list_contains(used, k) THEN -1e0 ELSE {SCORE} END) AS sc FROM r WHERE i < len(g))))
SELECT user_id, session, label, i::INT AS n, round(s / len(g), 6) AS iou FROM r WHERE i = len(g)""")
def greedy_match_miou(spark: SparkSession, sf: str) -> DataFrame:
    x = predicted(runs(spark, sf)).groupBy(*KEYS, "label").agg(F.array_sort(F.collect_list(F.struct(F.col("p0").alias("t0"), F.col("p1").alias("t1")))).alias("p"), F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("g"))
    return x.select(*KEYS, "label", F.size("g").alias("n"), F.round(iv.mean_best_iou(F.col("p"), F.col("g")), 6).alias("iou"))


WINDOWS = ", w AS (SELECT user_id, session, i AS window_id, (i - 1) * 7200e0 AS w0, i * 7200e0 AS w1 FROM procs, generate_series(1, 3) AS g(i))"


def windows(spark: SparkSession, sf: str) -> DataFrame:
    w = procedures(spark, sf).select(*KEYS, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("window_id"))
    return w.withColumn("w0", (F.col("window_id") - 1) * F.lit(7200.0)).withColumn("w1", F.col("window_id") * F.lit(7200.0))


@query(SQL + WINDOWS + """, o AS (SELECT w.user_id, w.session, window_id, label, min(run_id) AS f FROM w JOIN runs r ON r.user_id = w.user_id AND r.session = w.session AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL),
l AS (SELECT user_id, session, window_id, string_agg(label, ',' ORDER BY f, label) AS labels FROM o GROUP BY ALL)
SELECT w.user_id, w.session, w.window_id, coalesce(labels, '') AS labels FROM w LEFT JOIN l USING (user_id, session, window_id)""")
def window_active_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = tl.active_labels(windows(spark, sf), runs(spark, sf), KEYS, "window_id")
    return x.select(*KEYS, "window_id", F.array_join("labels", ",").alias("labels"))


@query(SQL + WINDOWS + "SELECT w.user_id, w.session, window_id, label, round(sum(least(t1, w1) - greatest(t0, w0)), 6) AS seconds FROM w JOIN runs r ON r.user_id = w.user_id AND r.session = w.session AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL")
def window_clip(spark: SparkSession, sf: str) -> DataFrame:
    x = tl.overlapping(windows(spark, sf), runs(spark, sf), KEYS)
    return x.groupBy(*KEYS, "window_id", "label").agg(F.round(F.sum(F.col("c1") - F.col("c0")), 6).alias("seconds"))


#: The windows of whole sessions.
EVERY = ", w AS (SELECT user_id, session, i AS window_id, (i - 1) * 7200e0 AS w0, i * 7200e0 AS w1 FROM procs, generate_series(1, ceil(dur / 7200e0)::BIGINT) AS g(i))"


def every_window(spark: SparkSession, sf: str) -> DataFrame:
    n = F.ceil(F.col("duration_s") / 7200.0)
    w = procedures(spark, sf).filter("duration_s > 0").select(*KEYS, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("window_id"))
    return w.withColumn("w0", (F.col("window_id") - 1) * F.lit(7200.0)).withColumn("w1", F.col("window_id") * F.lit(7200.0))


@query(SQL + EVERY + """, o AS (SELECT w.user_id, w.session, window_id, label, min(run_id) AS f FROM w JOIN runs r ON r.user_id = w.user_id AND r.session = w.session AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL),
l AS (SELECT user_id, session, window_id, string_agg(label, ',' ORDER BY f, label) AS labels FROM o GROUP BY ALL)
SELECT w.user_id, w.session, w.window_id, coalesce(labels, '') AS labels FROM w LEFT JOIN l USING (user_id, session, window_id)""")
def window_active_labels_all(spark: SparkSession, sf: str) -> DataFrame:
    """``window_active_labels`` over the windows of whole sessions."""
    x = tl.active_labels(every_window(spark, sf), runs(spark, sf), KEYS, "window_id")
    return x.select(*KEYS, "window_id", F.array_join("labels", ",").alias("labels"))


@query(SQL + EVERY + "SELECT w.user_id, w.session, window_id, label, round(sum(least(t1, w1) - greatest(t0, w0)), 6) AS seconds FROM w JOIN runs r ON r.user_id = w.user_id AND r.session = w.session AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL")
def window_clip_all(spark: SparkSession, sf: str) -> DataFrame:
    """``window_clip`` over the windows of whole sessions."""
    x = tl.overlapping(every_window(spark, sf), runs(spark, sf), KEYS)
    return x.groupBy(*KEYS, "window_id", "label").agg(F.round(F.sum(F.col("c1") - F.col("c0")), 6).alias("seconds"))


@query(SQL + """, n AS (SELECT user_id, session, round_even(dur * (1e0 / 3600), 0)::INT AS n FROM procs),
g AS (SELECT user_id, session, i::INT AS sec FROM n, generate_series(0, n.n - 1) AS s(i) WHERE n.n > 0),
e AS (SELECT r.user_id, r.session, run_id, label, greatest(0, round_even(t0 * (1e0 / 3600), 0)::INT) AS a, least(n.n, greatest(0, round_even(t1 * (1e0 / 3600), 0)::INT)) AS b FROM runs r JOIN n USING (user_id, session)),
p AS (SELECT user_id, session, run_id, label, i::INT AS sec FROM e, generate_series(a, b - 1) AS s(i) WHERE b > a),
t AS (SELECT user_id, session, sec, arg_max(label, run_id) AS label FROM p GROUP BY ALL)
SELECT g.user_id, g.session, g.sec, coalesce(label, 'none') AS label FROM g LEFT JOIN t USING (user_id, session, sec)""")
def rasterize_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return tl.rasterize(runs(spark, sf), KEYS, procedures(spark, sf), 1 / 3600, "none").select(*KEYS, "sec", "label")


@query(SQL + "SELECT user_id, session, i * 3600e0 AS probe_t_s, round((dur - i * 3600e0) / 60e0, 8) AS minutes FROM procs, generate_series(1, (ceil(dur / 3600e0) - 1)::BIGINT) AS g(i) WHERE ceil(dur / 3600e0) - 1 >= 1")
def probe_grid(spark: SparkSession, sf: str) -> DataFrame:
    x = procedures(spark, sf).select("*", F.explode(iv.probe_times(F.col("duration_s"), 3600.0)).alias("probe_t_s"))
    return x.select(*KEYS, "probe_t_s", F.round((F.col("duration_s") - F.col("probe_t_s")) / 60, 8).alias("minutes"))


@query(SQL + "SELECT user_id, session, run_id, i::INT AS i, round(t0 + i * ((t1 - t0) / 4), 1) AS t FROM runs, generate_series(0, 4) AS g(i) WHERE t1 > t0")
def sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).filter("t1 > t0").select(*KEYS, "run_id", F.posexplode(iv.sample_times(F.col("t0"), F.col("t1"), 5)).alias("i", "t"))


@query(SQL + f"SELECT {BUCKET.format('dur')} AS len_bucket, count(*) AS n, round(avg(dur), 4) AS mean_s FROM procs GROUP BY 1")
def length_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return procedures(spark, sf).groupBy(iv.length_bucket(F.col("duration_s")).alias("len_bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_s"), 4).alias("mean_s"))


TOOLS = " OR ".join(f"contains(lower(text), '{k}')" for k in iv.TOOL_WORDS)


@query(f"SELECT lang, CASE WHEN n_chars < 2700 THEN 'short' WHEN n_chars >= 7200 OR {TOOLS} THEN 'retrieve' ELSE 'hier' END AS regime, count(*) AS n FROM documents GROUP BY ALL")
def regime_route(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("lang", iv.regime(F.col("n_chars"), F.col("text")).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


PRED = "CASE WHEN event_id % 10 < 8 THEN label ELSE 'view' END"


@query(SQL + f"SELECT user_id, round(avg(CASE WHEN {PRED} = label THEN 1e0 ELSE 0e0 END), 6) AS frame_acc FROM frames WHERE label <> 'error' GROUP BY user_id")
def frame_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).select("user_id", F.col("label").alias("gt"), F.expr(PRED).alias("pred"))
    return m.frame_accuracy(x, ["user_id"], background="error").select("user_id", r6("frame_acc"))


CODE = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS)) + " END"


@query(SQL + f""", s AS (SELECT user_id, session, coalesce(string_agg(chr({CODE} + 33), '' ORDER BY run_id) FILTER (WHERE run_id % 3 <> 0), '') AS p, string_agg(chr({CODE} + 33), '' ORDER BY run_id) AS g FROM runs GROUP BY ALL)
SELECT user_id, session, round((1 - levenshtein(p, g)::DOUBLE / greatest(length(p), length(g))) * 100, 6) AS edit FROM s""")
def edit_score(spark: SparkSession, sf: str) -> DataFrame:
    x = runs(spark, sf).select(*KEYS, "run_id", F.expr(CODE).alias("code"))
    both = x.withColumn("side", F.lit("gt")).union(x.filter("run_id % 3 <> 0").withColumn("side", F.lit("pred")))
    return m.edit_score(both, KEYS, "pred", "gt").select(*KEYS, r6("edit"))


@query(SQL + """, x AS (SELECT p.user_id, p.session, p.run_id AS p, g.run_id AS g, greatest(0e0, least(p.p1, g.t1) - greatest(p.p0, g.t0)) / (greatest(p.p1, g.t1) - least(p.p0, g.t0)) AS iou FROM runs p JOIN runs g ON p.user_id = g.user_id AND p.session = g.session AND p.label = g.label WHERE greatest(p.p1, g.t1) > least(p.p0, g.t0)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, session, p ORDER BY iou DESC, g) AS k FROM x WHERE iou > 0),
h AS (SELECT user_id, session, count(DISTINCT g) AS tp FROM b WHERE k = 1 AND iou >= 0.9 GROUP BY ALL),
n AS (SELECT user_id, session, count(*) AS n FROM runs GROUP BY ALL)
SELECT n.user_id, n.session, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fp, n - coalesce(tp, 0) AS fn, round(200e0 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + 2 * (n - coalesce(tp, 0))), 6) AS f1 FROM n LEFT JOIN h USING (user_id, session)""")
def segmental_f1(spark: SparkSession, sf: str) -> DataFrame:
    gt = predicted(runs(spark, sf))
    pred = gt.select(*KEYS, "run_id", "label", F.col("p0").alias("t0"), F.col("p1").alias("t1"))
    c = m.segmental_counts(pred, gt, KEYS, 0.9)
    return c.select("*", F.round(F.coalesce(F.try_divide(200.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6).alias("f1"))


RSD = SQL + """, r AS (SELECT user_id, session, i, (dur - i * 3600e0) / 60e0 AS gt_min, (dur - i * 3600e0) / 60e0 * (1 + ((user_id * 7 + i * 13) % 41 - 20) / 1e2) AS pred_min, i * 3600e0 / dur AS elapsed_frac FROM procs, generate_series(1, (ceil(dur / 3600e0) - 1)::BIGINT) AS g(i) WHERE ceil(dur / 3600e0) - 1 >= 1)
"""


def duration_records(spark: SparkSession, sf: str) -> DataFrame:
    x = procedures(spark, sf).select("*", F.explode(iv.probe_times(F.col("duration_s"), 3600.0)).alias("t"))
    x = x.withColumn("gt_min", (F.col("duration_s") - F.col("t")) / 60)
    return x.select("gt_min", (F.col("gt_min") * (1 + ((F.col("user_id") * 7 + F.round(F.col("t") / 3600).cast("long") * 13) % 41 - 20) / 100)).alias("pred_min"), (F.col("t") / F.col("duration_s")).alias("elapsed_frac"))


BUCKET_MIN = "(CASE WHEN {0} >= 15 THEN 1 ELSE 0 END + CASE WHEN {0} >= 30 THEN 1 ELSE 0 END + CASE WHEN {0} >= 60 THEN 1 ELSE 0 END)"


@query(RSD + f"SELECT round(avg(abs(pred_min - gt_min)), 6) AS mae_min, round(avg(CASE WHEN abs(pred_min - gt_min) <= 5 THEN 1e0 ELSE 0e0 END), 6) AS within5, round(avg(CASE WHEN abs(pred_min - gt_min) <= 10 THEN 1e0 ELSE 0e0 END), 6) AS within10, round(avg(CASE WHEN {BUCKET_MIN.format('pred_min')} = {BUCKET_MIN.format('gt_min')} THEN 1e0 ELSE 0e0 END), 6) AS bucket_acc, count(*) AS n FROM r")
def rsd_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = m.duration_report(duration_records(spark, sf))
    return x.select(*[r6(c) for c in x.columns if c != "n"], "n")


@query(RSD + ", d AS (SELECT greatest(0, least(9, floor(elapsed_frac * 10)))::INT AS decile, avg(abs(pred_min - gt_min)) AS e, count(*) AS n FROM r GROUP BY 1) SELECT i::INT AS decile, round(e, 6) AS mae_min, coalesce(n, 0) AS n FROM generate_series(0, 9) AS g(i) LEFT JOIN d ON d.decile = i")
def rsd_by_decile(spark: SparkSession, sf: str) -> DataFrame:
    return m.duration_by_decile(duration_records(spark, sf)).select("decile", r6("mae_min"), "n")


@query(SQL + "SELECT user_id, session, run_id, label, lead(label) OVER w AS next_label, round(lead(t0) OVER w, 6) AS next_t0 FROM runs WINDOW w AS (PARTITION BY user_id, session ORDER BY run_id)")
def next_run(spark: SparkSession, sf: str) -> DataFrame:
    return tl.next_run(runs(spark, sf), KEYS).select(*KEYS, "run_id", "label", "next_label", r6("next_t0"))


@query(SQL + "SELECT p.user_id, p.session, l.label FROM procs p, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS l(label) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.user_id = p.user_id AND r.session = p.session AND r.label = l.label)")
def absent_labels(spark: SparkSession, sf: str) -> DataFrame:
    vocab = spark.createDataFrame([(x,) for x in LABELS], "name string")
    return tl.absent_labels(procedures(spark, sf), vocab, runs(spark, sf), KEYS).select(*KEYS, "label")


@query(SQL + ", c AS (SELECT user_id, session, floor(t / 3600e0)::BIGINT AS sec, label, count(*) AS n FROM frames GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, session, sec ORDER BY n DESC, label) AS r FROM c) SELECT user_id, session, sec, label FROM k WHERE r = 1")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).withColumn("t", F.col("t") / 3600)
    return tl.majority_per_second(x, KEYS, "t", "label").select(*KEYS, F.col("sec").cast("long").alias("sec"), "label")


@query(SQL + "SELECT user_id, session, i * 10800e0 AS w0, least(i * 10800e0 + 21600, dur) AS w1 FROM procs, generate_series(0, ceil(dur / 10800e0)::BIGINT - 1) AS g(i)")
def clip_windows(spark: SparkSession, sf: str) -> DataFrame:
    x = procedures(spark, sf).select(*KEYS, F.explode(iv.clip_windows(F.col("duration_s"), 21600.0, 10800.0)).alias("w"))
    return x.select(*KEYS, F.col("w.t0").alias("w0"), F.col("w.t1").alias("w1"))


@query(SQL + "SELECT user_id, session, run_id, round(greatest(0e0, t0 - 120), 6) AS w0, round(least(dur, t1 + 120), 6) AS w1 FROM runs JOIN procs USING (user_id, session)")
def next_window(spark: SparkSession, sf: str) -> DataFrame:
    x = runs(spark, sf)
    w = iv.next_window(F.col("t0"), F.col("t1"), 120.0, F.col("duration_s"))
    return x.join(tl.durations(x, KEYS), KEYS).select(*KEYS, "run_id", w.alias("w")).select(*KEYS, "run_id", F.round("w.t0", 6).alias("w0"), F.round("w.t1", 6).alias("w1"))


@query("SELECT doc_id, i * 1000 AS start, least((i + 1) * 1000, n_chars) AS stop FROM documents, generate_series(0, ceil(n_chars / 1e3)::BIGINT - 1) AS g(i) WHERE n_chars > 0")
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", F.explode(iv.micro_batches(F.col("n_chars"), 1000)).alias("b"))
    return x.select("doc_id", F.col("b.start").cast("long").alias("start"), F.col("b.stop").cast("long").alias("stop"))


@query("SELECT doc_id, (ceil(n_chars / 2e0) * 64)::BIGINT AS tokens FROM documents")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", iv.vision_tokens(F.col("n_chars"), 256, 2, 2).alias("tokens"))


CUSTOMER = "SELECT c_custkey AS id, c_acctbal AS t0, c_acctbal + (c_custkey % 7) * 5 AS t1 FROM customer"
SUPPLIER = "SELECT s_suppkey AS id, s_acctbal AS t0, s_acctbal + (s_suppkey % 11) * 5 AS t1 FROM supplier"


@query(f"WITH a AS ({CUSTOMER}), b AS ({SUPPLIER}) SELECT a.id AS c, b.id AS s, round(least(a.t1, b.t1) - greatest(a.t0, b.t0), 4) AS overlap FROM a JOIN b ON least(a.t1, b.t1) - greatest(a.t0, b.t0) > 0")
def overlap_join_global(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("t0"), (F.col("c_acctbal") + F.col("c_custkey") % 7 * 5).alias("t1"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("t0"), (F.col("s_acctbal") + F.col("s_suppkey") % 11 * 5).alias("t1"))
    j = tl.overlap_join_global(a, b, 10.0)
    return j.select(F.col("l.id").alias("c"), F.col("r.id").alias("s"), F.round(iv.overlap(F.col("l.t0"), F.col("l.t1"), F.col("r.t0"), F.col("r.t1")), 4).alias("overlap"))
