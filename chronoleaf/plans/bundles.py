"""Driver queries on metric bundles, evaluation of prediction tables, and the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.functions import intervals as iv
from chronoleaf.operators import evaluate as ev
from chronoleaf.operators import graph as g
from chronoleaf.operators import metrics as m
from chronoleaf.operators import provenance as pr
from chronoleaf.operators import report
from chronoleaf.operators import selection as sel
from chronoleaf.operators import timeline as tl
from chronoleaf.plans.base import BUCKET, KEYS, SQL, TIOU, frames, predicted, runs, scratch, stored, table
from chronoleaf.plans.files import as_text
from chronoleaf.plans.graphs import VIOL, edges
from chronoleaf.plans.intervals import CODE, PRED, span
from chronoleaf.plans.items import videos_and_timeline
from chronoleaf.plans.language import NAMES, NORM, PAIRS, RANKS
from chronoleaf.plans.scores import BINS, CONF, CURVE, POISSON, SCORED, confident, drawn, scored
from chronoleaf.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *plain: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c) if c in plain else F.round(F.col(f"`{c}`"), 6).alias(c) for c in df.columns])


def f1_sql(name: str, overlap: float) -> str:
    return f"""{name} AS (SELECT n.user_id, n.session, round(200e0 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + (np - coalesce(tp, 0)) + (ng - coalesce(tp, 0))), 6) AS f FROM cnt n LEFT JOIN (SELECT user_id, session, count(DISTINCT g) AS tp FROM bst WHERE k = 1 AND iou >= {overlap} GROUP BY ALL) h USING (user_id, session))"""


@query(SQL + f""", pp AS (SELECT * FROM runs WHERE run_id % 3 <> 0), s AS (SELECT user_id, session, coalesce(string_agg(chr({CODE} + 33), '' ORDER BY run_id) FILTER (WHERE run_id % 3 <> 0), '') AS p, string_agg(chr({CODE} + 33), '' ORDER BY run_id) AS g FROM runs GROUP BY ALL),
x AS (SELECT p.user_id, p.session, p.run_id AS p, g.run_id AS g, greatest(0e0, least(p.p1, g.t1) - greatest(p.p0, g.t0)) / (greatest(p.p1, g.t1) - least(p.p0, g.t0)) AS iou FROM pp p JOIN runs g ON p.user_id = g.user_id AND p.session = g.session AND p.label = g.label WHERE greatest(p.p1, g.t1) > least(p.p0, g.t0)),
bst AS (SELECT *, row_number() OVER (PARTITION BY user_id, session, p ORDER BY iou DESC, g) AS k FROM x WHERE iou > 0), cnt AS (SELECT user_id, session, count(*) AS ng, count_if(run_id % 3 <> 0) AS np FROM runs GROUP BY ALL),
{f1_sql('a', 0.1)}, {f1_sql('b', 0.25)}, {f1_sql('c', 0.5)}, d AS (SELECT user_id, session, round(avg(CASE WHEN {PRED} = label THEN 1e0 ELSE 0e0 END), 6) AS frame_acc FROM frames GROUP BY ALL)
SELECT user_id, session, round((1 - levenshtein(s.p, s.g)::DOUBLE / greatest(length(s.p), length(s.g))) * 100, 6) AS edit, frame_acc, a.f AS f10, b.f AS f25, c.f AS f50 FROM s JOIN a USING (user_id, session) JOIN b USING (user_id, session) JOIN c USING (user_id, session) JOIN d USING (user_id, session)""")
def segment_bundle(spark: SparkSession, sf: str) -> DataFrame:
    gt = predicted(runs(spark, sf))
    pred = gt.filter("run_id % 3 <> 0").select(*KEYS, "run_id", "label", F.col("p0").alias("t0"), F.col("p1").alias("t1"))
    dense = frames(spark, sf).select(*KEYS, F.col("label").alias("gt"), F.expr(PRED).alias("pred"))
    x = ev.segment_bundle(dense, pred, gt.select(*KEYS, "run_id", "label", "t0", "t1"), KEYS)
    return rounded(x.withColumnsRenamed({"segF1@10": "f10", "segF1@25": "f25", "segF1@50": "f50"}), *KEYS)


@query(SCORED + """, t AS (SELECT cls, score, sum(label) AS tp, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT cls, tp, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn, sum(tp) OVER (PARTITION BY cls) AS pos, sum(n) OVER (PARTITION BY cls) AS al FROM t WINDOW o AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT cls, sum(tp::DOUBLE / pos * ctp / cn) AS ap FROM w WHERE pos > 0 AND pos < al GROUP BY cls), c AS (SELECT cls, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp, count_if(score < 0.5 AND label = 1) AS fn FROM s GROUP BY cls)
SELECT round((SELECT avg(ap) FROM ap), 6) AS map, round((SELECT avg(2e0 * tp / nullif(2 * tp + fp + fn, 0)) FROM c), 6) AS macro_f1, (SELECT count(DISTINCT event_id) FROM s) AS n""")
def detection_bundle_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = ev.detection_bundle(scored(spark, sf).withColumnRenamed("event_id", "item"))
    return rounded(x.withColumnsRenamed({"det_mAP": "map", "det_macro_f1": "macro_f1"}), "n")


@query(SQL + """, a AS (SELECT user_id, session, label, min(run_id) AS f FROM runs GROUP BY ALL), n AS (SELECT user_id, session, count(*) AS ng, count_if(f <= 2) AS tp FROM a GROUP BY ALL)
SELECT round(avg(2e0 * tp / (tp + ng)), 6) AS map, round(avg(tp::DOUBLE / ng), 6) AS jaccard, count(*) AS n FROM n""")
def detection_bundle_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Without scores, macro F1 of label sets stands in the place of mean average precision."""
    x = runs(spark, sf).groupBy(*KEYS).agg(F.collect_list(F.when(F.col("run_id") <= 2, F.upper("label"))).alias("pred_labels"), F.collect_list("label").alias("gt_labels"))
    return rounded(ev.detection_bundle(x).select(F.col("det_mAP").alias("map"), "jaccard", "n"), "n")


PARENT = "CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE n_regionkey END"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("parent_phase"))


@query(VIOL + f""", back AS (SELECT DISTINCT x.user_id, x.session FROM runs x JOIN runs y ON x.user_id = y.user_id AND x.session = y.session AND x.run_id > y.run_id JOIN reach ON a = y.label AND b = x.label),
k AS (SELECT user_id, session, CASE session % 4 WHEN 0 THEN NOT EXISTS (SELECT 1 FROM v WHERE v.user_id = p.user_id AND v.session = p.session) WHEN 1 THEN NOT EXISTS (SELECT 1 FROM back w WHERE w.user_id = p.user_id AND w.session = p.session) ELSE coalesce({PARENT} = p.user_id % 5, true) END AS ok FROM procs p JOIN nation ON n_nationkey = p.user_id % 25 WHERE session % 4 < 3)
SELECT round(avg(ok::INT), 6) AS temporal_consistency, count(*) AS checked FROM k""")
def temporal_consistency_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in three forms: spans, labels in (reversed) order, a step with a phase; a fourth of them has none."""
    form = F.col("session") % 4
    x = runs(spark, sf).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("run_id", "label", "t0", "t1"))).alias("r"))
    spans = F.transform("r", lambda s: F.struct(s["label"].alias("label"), s["t0"].alias("t0"), s["t1"].alias("t1")))
    x = x.select(
        *KEYS,
        F.when(form == 0, spans).alias("labeled_spans"),
        F.when(form.isin(0, 1), F.reverse(F.transform("r", lambda s: s["label"]))).alias("ordered_labels"),
        F.when(form != 3, F.col("user_id") % 25).alias("step"),
        (F.col("user_id") % 5).alias("phase"),
    )
    return rounded(ev.temporal_consistency(x, g.closure(edges(spark)), steps(spark, sf), KEYS), "checked")


@query(PAIRS + f""", t AS (SELECT conv_id, {NORM.format('pred')} AS p, {NORM.format('gold')} AS g FROM c WHERE gold IS NOT NULL),
s AS (SELECT conv_id, p, g, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same FROM t)
SELECT round(avg(CASE WHEN p = g THEN 1e0 ELSE 0e0 END), 6) AS qa_em, round(avg(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1e0 WHEN same = 0 THEN 0e0 ELSE 2e0 * same / (len(p) + len(g)) END), 6) AS qa_f1, count(*) AS n, round(avg(coalesce({PARENT} = conv_id % 5, true)::INT), 6) AS temporal_consistency FROM s JOIN nation ON n_nationkey = conv_id % 25""")
def qa_bundle(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("pred_text"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))
    c = c.filter("answer is not null").withColumn("step", F.col("conv_id") % 25).withColumn("phase", F.col("conv_id") % 5)
    return rounded(ev.qa_bundle(c, g.closure(edges(spark)), steps(spark, sf), ["conv_id", "turn"]), "n")


@query(CONF + BINS + ", t AS (SELECT *, ntile(15) OVER (ORDER BY conf, id) - 1 AS bin FROM r), q AS (SELECT bin, avg(conf) AS conf, avg(correct) AS acc, count(*) AS n FROM t GROUP BY 1)" + CURVE + """, a AS (SELECT (risk + lag(risk) OVER (ORDER BY k)) / 2 * (coverage - lag(coverage) OVER (ORDER BY k)) AS a FROM c), p AS (SELECT conf, sum(correct) AS p, sum(1 - correct) AS q FROM r GROUP BY conf), u AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM p)
SELECT round((SELECT sum(n * abs(acc - conf)) / sum(n) FROM b), 6) AS ece, round((SELECT sum(n * abs(acc - conf)) / sum(n) FROM q), 6) AS ece_adapt, round((SELECT sum(a) FROM a), 6) AS aurc, round((SELECT risk FROM c WHERE k = greatest(1, round_even(0.8 * n, 0)::INT)), 6) AS risk_80, round((SELECT sum(u) / (sum(p) * sum(q)) FROM u), 6) AS conf_auroc, 1.5e0 AS t, (SELECT count(*) FROM r) AS n""")
def reliability_bundle(spark: SparkSession, sf: str) -> DataFrame:
    x = ev.reliability_bundle(confident(spark, sf), "id", 1.5)
    return rounded(x.withColumnsRenamed({"risk@0.8cov": "risk_80", "T": "t"}), "n")


@query(f"""WITH h AS (SELECT doc_id, strpos(lower(text), n.name) AS pos, n.name, n.rank FROM documents, (VALUES {RANKS}) AS n(name, rank)), s AS (SELECT * FROM h WHERE pos > 0),
p AS (SELECT a.doc_id, count(*) AS inversions, count_if(b.name = 'the' AND a.name = 'ti') AS hard FROM s a JOIN s b ON a.doc_id = b.doc_id AND (a.pos, a.name) < (b.pos, b.name) AND a.rank > b.rank GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
SELECT round(avg(coalesce(inversions / nullif(n * (n - 1) / 2, 0), 0)), 6) AS violation_rate, sum(coalesce(hard, 0))::BIGINT AS hard, round(avg(coalesce(n, 0) / 5e0), 6) AS coverage, count(*) AS n FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)""")
def summary_bundle(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("pred"), F.array(*[F.lit(x) for x in NAMES]).alias("names"))
    x = ev.summary_bundle(d, spark.createDataFrame([("the", "ti")], "a string, b string"), ["doc_id"])
    return rounded(x.toDF("violation_rate", "hard", "coverage", "n"), "hard", "n")


REP = 20
UNIT = "(user_id * 1000000 + session * 1000 + run_id)"
EVAL = SQL + f""", x AS (SELECT label AS method, CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, {UNIT} AS unit, {TIOU.format('p0', 'p1', 't0', 't1')} AS iou, {BUCKET.format('dur')} AS b,
 CASE WHEN run_id % 4 <> 0 THEN abs(dur / 60e0 * ((run_id % 7 - 3) / 1e1)) END AS e, CASE WHEN run_id % 5 = 0 THEN 0e0 ELSE 1e0 END AS em FROM runs JOIN procs USING (user_id, session))"""
EVAL_METRICS = "round(avg((iou >= 0.5)::INT), 6) AS r1_50, round(avg(iou), 6) AS miou, round(avg(e), 6) AS rsd_mae, round(avg((e <= 5)::INT), 6) AS within5, round(avg(em), 6) AS qa_em, count(*)::DOUBLE AS n_items"


@query(EVAL + f""", u AS (SELECT method, split, rep, iou, {drawn('unit')} AS u FROM x, generate_series(0, {REP - 1}) AS g(rep)), w AS (SELECT method, split, rep, sum(iou * ({POISSON})) / nullif(sum({POISSON}), 0) AS m FROM u GROUP BY ALL),
ci AS (SELECT method, split, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM w GROUP BY ALL)
SELECT 'spark' AS backend, method, split, 'overall' AS len_bucket, {EVAL_METRICS}, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi, '7' AS seed FROM x JOIN ci USING (method, split) GROUP BY ALL UNION ALL SELECT 'spark', method, split, b, {EVAL_METRICS}, NULL, NULL, '7' FROM x GROUP BY ALL""")
def evaluate_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A table of predictions to result rows: grounding, remaining duration and answers, with bootstrap intervals."""
    x = predicted(runs(spark, sf))
    x = x.join(tl.durations(x, KEYS), KEYS)
    minutes = F.col("duration_s") / 60
    preds = x.select(
        F.lit("spark").alias("backend"),
        F.col("label").alias("method"),
        F.when(F.col("user_id") % 3 == 0, "test").otherwise("train").alias("split"),
        (F.col("user_id") * 1_000_000 + F.col("session") * 1000 + F.col("run_id")).alias("unit"),
        span("p0", "p1").alias("pred_spans"),
        span("t0", "t1").alias("gt_spans"),
        "duration_s",
        F.when(F.col("run_id") % 4 != 0, minutes * (1 + (F.col("run_id") % 7 - 3) / 10)).alias("pred_min"),
        minutes.alias("gt_min"),
        F.when(F.col("run_id") % 5 == 0, "nothing").otherwise(F.concat(F.lit("The "), F.upper("label"))).alias("pred"),
        F.col("label").alias("gold"),
    )
    cells = pr.stamped(ev.evaluate(preds, "unit", "miou", REP), {"seed": "7"})
    out = report.flatten(cells)
    names = {"r1@0.5": "r1_50", "miou": "miou", "rsd_mae_min": "rsd_mae", "rsd_within5": "within5", "qa_em": "qa_em", "n_items": "n_items", "ci_lo": "ci_lo", "ci_hi": "ci_hi"}
    return out.select("backend", "method", "split", "len_bucket", *[F.round(F.col(f"`{a}`"), 6).alias(b) for a, b in names.items()], "seed")


@query("SELECT s_name AS method, 'overall' AS len_bucket, s_acctbal AS miou, s_nationkey::DOUBLE AS n_items, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal - 1.5e0 END AS ci_lo, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 2.5e0 END AS ci_hi FROM supplier")
def source_result_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Result files whose metrics hold an interval as a list under either of its names, and aliases of metrics."""
    s = table(spark, sf, "supplier")
    bal = F.col("s_acctbal")
    name = F.when(F.col("s_suppkey") % 4 == 0, "ci").otherwise("bootstrap_ci")
    ci = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(', "'), name, F.lit('": ['), (bal - 1.5).cast("string"), F.lit(", "), (bal + 2.5).cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit('{"method": "'), F.col("s_name"), F.lit('", "metrics": {"miou": '), bal.cast("string"), F.lit(', "n": '), F.col("s_nationkey"), ci, F.lit("}}"))
    path = as_text(s.select(F.col("s_suppkey").cast("string").alias("video"), line.alias("value")), scratch(spark, "intervals"))
    x = report.flatten(readers.read_results(spark, path))
    return x.select("method", "len_bucket", "miou", "n_items", *[F.round(c, 6).alias(c) for c in ("ci_lo", "ci_hi")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END END AS split FROM customer")
def split_official_table(spark: SparkSession, sf: str) -> DataFrame:
    """A split given as a table that lacks some ids."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    official = c.filter("c_custkey % 10 <> 9").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("train").alias("split"))
    return sel.fixed_split(c, "c_custkey", "official_per_center", official=official).select("c_custkey", "split")


def drawn_split(strata: str, a: float, b: float) -> str:
    over = f"PARTITION BY {strata} " if strata else ""
    return f"WITH k AS (SELECT c_custkey, row_number() OVER ({over}ORDER BY md5('0:' || c_custkey::VARCHAR), c_custkey) AS k, count(*) OVER ({over}) AS n FROM customer), s AS (SELECT c_custkey, CASE WHEN k <= round_even(n * {a!r}::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * {a!r}::DOUBLE, 0) + round_even(n * {b!r}::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM k)"


@query(drawn_split("c_mktsegment", 0.6, 0.15) + " SELECT * FROM s")
def split_official_per_center(spark: SparkSession, sf: str) -> DataFrame:
    """Without a table, shares of each center."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return sel.fixed_split(c, "c_custkey", "official_per_center", center="c_mktsegment").select("c_custkey", "split")


@query(drawn_split("", 0.5, 0.25) + " SELECT * FROM s")
def split_by_video(spark: SparkSession, sf: str) -> DataFrame:
    return sel.fixed_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "by_video", (20, 10, 10))


@query(drawn_split("", 0.6, 0.2) + " SELECT * FROM s")
def split_rdv(spark: SparkSession, sf: str) -> DataFrame:
    return sel.fixed_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "rdv")


@query("WITH n AS (SELECT n_name, row_number() OVER (ORDER BY coalesce(try_cast(regexp_replace(n_name, '\\D', '', 'g') AS BIGINT), 0), n_name) AS k FROM nation) SELECT n_name, CASE WHEN k <= 10 THEN 'train' WHEN k <= 14 THEN 'val' WHEN k <= 21 THEN 'test' END AS split FROM n")
def split_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return sel.fixed_split(table(spark, sf, "nation").select("n_name"), "n_name", "official_10_4_7")


@query(drawn_split("", 0.6, 0.2) + " SELECT c_custkey FROM s WHERE split = 'val'")
def split_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one split; an empty one would raise."""
    c = sel.fixed_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "rdv")
    return sel.videos_of(c, "val").select("c_custkey")


@query("WITH q AS (SELECT DISTINCT 'Which ' || role || ' is it?' AS orig, 'kind ' || turn % 3 AS sub FROM conversations) SELECT left(sha1(orig || chr(31) || sub || chr(31) || 'm'), 16) AS key, orig FROM q")
def paraphrase_requests(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.concat(F.lit("Which "), F.col("role"), F.lit(" is it?")).alias("q"), F.concat(F.lit("kind "), F.col("turn") % 3).alias("sub"))
    return sel.paraphrase_requests(c, "q", "sub", "m")


@query("SELECT doc_id, (ceil(n_chars / 2e0) * 64 + length(coalesce(text, '')))::BIGINT AS ctx, (ceil(n_chars / 4e0) * 16)::BIGINT AS short, (ceil((n_chars * 3) / 4e0) * 16)::BIGINT AS hier FROM documents")
def context_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of frames and text together, and of the frames that each regime takes."""
    n = F.col("n_chars")
    by = iv.tokens_per_video(F.create_map(F.lit("short"), n, F.lit("hier"), n * 3), 64, 4, 2)
    ctx = iv.context_length(iv.vision_tokens(n, 256, 2, 2), F.length(F.coalesce("text", F.lit(""))))
    return table(spark, sf, "documents").select("doc_id", ctx.alias("ctx"), by["short"].alias("short"), by["hier"].alias("hier"))


@query(SQL + """, g AS (SELECT user_id, session, t0, t1 FROM runs WHERE label = 'error'), p AS (SELECT user_id, session, t0 + (t1 - t0) * (run_id % 5 - 2) * 0.4e0 AS t0, t1 + (t1 - t0) * (run_id % 5 - 2) * 0.4e0 AS t1 FROM runs WHERE label = 'error' OR (label = 'view' AND run_id % 3 = 0)),
r AS (SELECT p.*, EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND g.session = p.session AND least(p.t1, g.t1) > greatest(p.t0, g.t0)) AS ok FROM p), f AS (SELECT g.*, EXISTS (SELECT 1 FROM p WHERE g.user_id = p.user_id AND g.session = p.session AND least(p.t1, g.t1) > greatest(p.t0, g.t0)) AS ok FROM g)
SELECT round((SELECT avg(ok::INT) FROM r), 6) AS precision, round((SELECT avg(ok::INT) FROM f), 6) AS recall, round((SELECT count_if(NOT ok) FROM r) / (SELECT sum(dur) / 3600 FROM procs), 6) AS alarms_h""")
def adverse_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rare events: precision, recall and false alarms an hour."""
    x = runs(spark, sf)
    by = (F.col("t1") - F.col("t0")) * (F.col("run_id") % 5 - 2) * 0.4
    pred = x.filter("label = 'error' or (label = 'view' and run_id % 3 = 0)").select(*KEYS, (F.col("t0") + by).alias("t0"), (F.col("t1") + by).alias("t1"))
    return rounded(ev.event_detection(pred, x.filter("label = 'error'"), tl.durations(x, KEYS), KEYS))


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of ids; an id that the vocabulary lacks is its own name."""
    vocab = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return tl.names_of(table(spark, sf, "customer"), vocab, "c_nationkey").select("c_custkey", "label")


@query(f"SELECT doc_id, md5('see ' || repeat('{an.MEDIA['internvl3_2b']}', 4) || ' ' || text) AS digest FROM documents")
def expanded_media(spark: SparkSession, sf: str) -> DataFrame:
    """Text of whole documents after a video mark that stands for four frames."""
    x = table(spark, sf, "documents").select("doc_id", an.expand_media(F.concat(F.lit("see <video> "), F.col("text")), 4).alias("t"))
    return x.select("doc_id", F.md5("t").alias("digest"))


@query(SQL + "SELECT user_id || '-' || session AS video_id, round(dur, 6) AS duration_s, count(*) AS n_runs FROM procs JOIN runs USING (user_id, session) GROUP BY ALL")
def item_videos(spark: SparkSession, sf: str) -> DataFrame:
    v, t = videos_and_timeline(spark, sf)
    n = t.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_runs"))
    return v.join(n, "video_id").select("video_id", F.round("duration_s", 6).alias("duration_s"), "n_runs")


@query("SELECT s_name, 'test' AS split FROM supplier")
def split_all_test(spark: SparkSession, sf: str) -> DataFrame:
    return sel.fixed_split(table(spark, sf, "supplier").select("s_name"), "s_name", "all_test")


LENGTH = "(event_id % 9000)"
FAMILY = f"""WITH {SCORED.removeprefix('WITH ')}, {CONF.removeprefix('WITH ')},
sd AS (SELECT *, {BUCKET.format(LENGTH)} AS b FROM s), sx AS (SELECT *, 'overall' AS len_bucket FROM sd UNION ALL SELECT *, b FROM sd),
st AS (SELECT len_bucket, cls, score, sum(label) AS tp, count(*) AS n FROM sx GROUP BY ALL), sw AS (SELECT len_bucket, cls, tp, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn, sum(tp) OVER (PARTITION BY len_bucket, cls) AS pos, sum(n) OVER (PARTITION BY len_bucket, cls) AS al FROM st WINDOW o AS (PARTITION BY len_bucket, cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT len_bucket, cls, sum(tp::DOUBLE / pos * ctp / cn) AS ap FROM sw WHERE pos > 0 AND pos < al GROUP BY ALL), f1 AS (SELECT len_bucket, cls, 2e0 * count_if(score >= 0.5 AND label = 1) / nullif(2 * count_if(score >= 0.5 AND label = 1) + count_if(score >= 0.5 AND label = 0) + count_if(score < 0.5 AND label = 1), 0) AS f1 FROM sx GROUP BY ALL),
det AS (SELECT len_bucket, round(det_map, 6) AS det_map, n_items FROM (SELECT len_bucket, avg(ap) AS det_map FROM ap GROUP BY 1) JOIN (SELECT len_bucket, count(DISTINCT event_id) AS n_items FROM sx GROUP BY 1) USING (len_bucket)),
rd AS (SELECT id, conf, correct, {BUCKET.format('(id % 9000)')} AS b FROM r), rx AS (SELECT *, 'overall' AS len_bucket FROM rd UNION ALL SELECT *, b FROM rd),
rk AS (SELECT *, least(floor(conf * 15)::INT, 14) AS w, ntile(15) OVER (PARTITION BY len_bucket ORDER BY conf, id) AS a, row_number() OVER d AS k, count(*) OVER (PARTITION BY len_bucket) AS n, sum(1 - correct) OVER (PARTITION BY len_bucket ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS e FROM rx WINDOW d AS (PARTITION BY len_bucket ORDER BY conf DESC, id)),
e1 AS (SELECT len_bucket, sum(g) / sum(n) AS ece FROM (SELECT len_bucket, w, abs(avg(correct) - avg(conf)) * count(*) AS g, count(*) AS n FROM rk GROUP BY ALL) GROUP BY 1), e2 AS (SELECT len_bucket, sum(g) / sum(n) AS ece_adapt FROM (SELECT len_bucket, a, abs(avg(correct) - avg(conf)) * count(*) AS g, count(*) AS n FROM rk GROUP BY ALL) GROUP BY 1),
cu AS (SELECT len_bucket, (sum(e / k) - (max(e / k) FILTER (WHERE k = 1) + max(e / k) FILTER (WHERE k = n)) / 2) / max(n) AS aurc, max(e / k) FILTER (WHERE k = greatest(1, round_even(0.8 * n, 0))) AS risk_80 FROM rk GROUP BY 1),
pc AS (SELECT len_bucket, conf, sum(correct) AS p, sum(1 - correct) AS q FROM rx GROUP BY ALL), au AS (SELECT len_bucket, sum(u) / (sum(p) * sum(q)) AS conf_auroc FROM (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY len_bucket ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM pc) GROUP BY 1),
rel AS (SELECT len_bucket, round(ece, 6) AS ece, round(ece_adapt, 6) AS ece_adapt, round(aurc, 6) AS aurc, round(risk_80, 6) AS risk_80, round(conf_auroc, 6) AS conf_auroc FROM e1 JOIN e2 USING (len_bucket) JOIN cu USING (len_bucket) JOIN au USING (len_bucket))"""


@query(FAMILY + """ SELECT 't4' AS task, len_bucket, det_map, ece, ece_adapt, aurc, risk_80, conf_auroc, n_items::DOUBLE AS n_items, 's' AS seed FROM det JOIN rel USING (len_bucket)""")
def evaluate_families(spark: SparkSession, sf: str) -> DataFrame:
    """Detection and reliability of one cell to result rows by length."""
    length = lambda c: (F.col(c) % 9000).cast("double").alias("duration_s")
    det = scored(spark, sf).select(F.lit("t4").alias("task"), F.col("event_id").alias("item"), "cls", "score", "label", length("event_id"))
    rel = confident(spark, sf).select(F.lit("t4").alias("task"), "id", "conf", "correct", length("id"))
    cells = pr.stamped(ev.family_cells([ev.detection_family(det, ["task"]), ev.reliability_family(rel, ["task"], "id").drop("n_items")]), {"seed": "s"})
    names = {"det_mAP": "det_map", "ece": "ece", "ece_adapt": "ece_adapt", "aurc": "aurc", "risk@0.8cov": "risk_80", "conf_auroc": "conf_auroc", "n_items": "n_items"}
    return report.flatten(cells).select("task", "len_bucket", *[F.round(F.col(f"`{a}`"), 6).alias(b) for a, b in names.items()], "seed")


@query(SQL + f""", pp AS (SELECT * FROM runs WHERE run_id % 3 <> 0), s AS (SELECT user_id, session, coalesce(string_agg(chr({CODE} + 33), '' ORDER BY run_id) FILTER (WHERE run_id % 3 <> 0), '') AS p, string_agg(chr({CODE} + 33), '' ORDER BY run_id) AS g FROM runs GROUP BY ALL),
x AS (SELECT p.user_id, p.session, p.run_id AS p, g.run_id AS g, greatest(0e0, least(p.p1, g.t1) - greatest(p.p0, g.t0)) / (greatest(p.p1, g.t1) - least(p.p0, g.t0)) AS iou FROM pp p JOIN runs g ON p.user_id = g.user_id AND p.session = g.session AND p.label = g.label WHERE greatest(p.p1, g.t1) > least(p.p0, g.t0)),
bst AS (SELECT *, row_number() OVER (PARTITION BY user_id, session, p ORDER BY iou DESC, g) AS k FROM x WHERE iou > 0), cnt AS (SELECT user_id, session, count(*) AS ng, count_if(run_id % 3 <> 0) AS np FROM runs GROUP BY ALL),
{f1_sql('a', 0.1).replace('round(', '(').replace(', 6)', ')')}, {f1_sql('c', 0.5).replace('round(', '(').replace(', 6)', ')')}, d AS (SELECT user_id, session, avg(CASE WHEN {PRED} = label THEN 1e0 ELSE 0e0 END) AS frame_acc FROM frames GROUP BY ALL),
v AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, {BUCKET.format('dur')} AS b, (1 - levenshtein(s.p, s.g)::DOUBLE / greatest(length(s.p), length(s.g))) * 100 AS edit, frame_acc, a.f AS f10, c.f AS f50 FROM s JOIN a USING (user_id, session) JOIN c USING (user_id, session) JOIN d USING (user_id, session) JOIN procs USING (user_id, session)), w AS (SELECT *, 'overall' AS len_bucket FROM v UNION ALL SELECT *, b FROM v)
SELECT 't2' AS task, split, len_bucket, round(avg(edit), 6) AS edit, round(avg(frame_acc), 6) AS frame_acc, round(avg(f10), 6) AS f10, round(avg(f50), 6) AS f50, count(*)::DOUBLE AS n_items FROM w GROUP BY ALL""")
def evaluate_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """Segmentation of videos to result rows by split and length."""
    cell = [F.lit("t2").alias("task"), F.when(F.col("user_id") % 3 == 0, "test").otherwise("train").alias("split")]
    gt = stored(predicted(runs(spark, sf)).select(*cell, *KEYS, "run_id", "label", "t0", "t1", "p0", "p1"), "segments")
    pred = gt.filter("run_id % 3 <> 0").select("task", "split", *KEYS, "run_id", "label", F.col("p0").alias("t0"), F.col("p1").alias("t1"))
    dense = frames(spark, sf).select(*cell, *KEYS, F.col("label").alias("gt"), F.expr(PRED).alias("pred"))
    x = ev.segmentation_family(dense, pred, gt.drop("p0", "p1"), tl.durations(gt, ["task", "split", *KEYS]), ["task", "split"], KEYS)
    out = report.flatten(ev.family_cells([x]).withColumn("provenance", F.create_map().cast("map<string,string>")))
    names = {"edit": "edit", "frame_acc": "frame_acc", "segF1@10": "f10", "segF1@50": "f50", "n_items": "n_items"}
    return out.select("task", "split", "len_bucket", *[F.round(F.col(f"`{a}`"), 6).alias(b) for a, b in names.items()])
