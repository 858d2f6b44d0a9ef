"""Driver queries on detection, calibration, abstention and efficiency metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.operators import metrics as m
from chronoleaf.plans.base import LABELS, SQL, frames, runs, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


VALUES = ", ".join(f"('{x}', {i})" for i, x in enumerate(LABELS))
SCORED = f"WITH s AS (SELECT event_id, c.name AS cls, ((event_id * 37 + c.k * 11) % 101) / 1e2 AS score, CASE WHEN event_type = c.name THEN 1 ELSE 0 END AS label FROM events, (VALUES {VALUES}) AS c(name, k))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.lit(i).alias("k")) for i, x in enumerate(LABELS)])).alias("c"))
    return e.select("event_id", F.col("c.name").alias("cls"), ((F.col("event_id") * 37 + F.col("c.k") * 11) % 101 / 100.0).alias("score"), (F.col("event_type") == F.col("c.name")).cast("int").alias("label"))


@query(SCORED + """, t AS (SELECT cls, score, sum(label) AS tp, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT cls, tp, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn, sum(tp) OVER (PARTITION BY cls) AS pos, sum(n) OVER (PARTITION BY cls) AS al FROM t WINDOW o AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT cls, round(sum(tp::DOUBLE / pos * ctp / cn), 6) AS ap FROM w WHERE pos > 0 AND pos < al GROUP BY cls""")
def frame_map(spark: SparkSession, sf: str) -> DataFrame:
    return m.average_precision(scored(spark, sf)).select("cls", r6("ap"))


@query(SCORED + """, c AS (SELECT cls, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp, count_if(score < 0.5 AND label = 1) AS fn FROM s GROUP BY cls)
SELECT round(avg(2e0 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1 FROM c""")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return m.macro_f1(scored(spark, sf)).select(r6("macro_f1"))


@query(SQL + """, a AS (SELECT user_id, session, label, min(run_id) AS f, max(run_id) AS l FROM runs GROUP BY ALL), n AS (SELECT user_id, session, count(*) AS ng, count_if(f <= 2) AS tp FROM a GROUP BY ALL)
SELECT round(sum(tp)::DOUBLE / sum(tp), 6) AS micro_p, round(sum(tp)::DOUBLE / sum(ng), 6) AS micro_r, round(2e0 * sum(tp) / (sum(tp) + sum(ng)), 6) AS micro_f1, round(avg(1e0), 6) AS macro_p, round(avg(tp::DOUBLE / ng), 6) AS macro_r, round(avg(2e0 * tp / (tp + ng)), 6) AS macro_f1, round(avg(tp::DOUBLE / ng), 6) AS jaccard, count(*) AS n FROM n""")
def set_prf_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    x = runs(spark, sf).groupBy("user_id", "session").agg(F.collect_list(F.when(F.col("run_id") <= 2, F.upper("label"))).alias("pred_labels"), F.collect_list("label").alias("gt_labels"))
    out = m.set_report(x)
    return out.select(*[r6(c) for c in out.columns if c != "n"], "n")


CONF = "WITH r AS (SELECT event_id AS id, (event_id * 7919 % 10007) / 10007e0 AS conf, CASE WHEN event_type IN ('view', 'purchase') THEN 1e0 ELSE 0e0 END AS correct FROM events)"


def confident(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 10007 / 10007.0).alias("conf"), F.col("event_type").isin("view", "purchase").cast("double").alias("correct"))


BINS = ", b AS (SELECT least(floor(conf * 15)::INT, 14) AS bin, avg(conf) AS conf, avg(correct) AS acc, count(*) AS n FROM r GROUP BY 1)"


@query(CONF + BINS + " SELECT i::INT AS bin, round(conf, 6) AS conf, round(acc, 6) AS acc, coalesce(n, 0) AS n FROM generate_series(0, 14) AS g(i) LEFT JOIN b ON bin = i")
def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    return m.calibration_bins(confident(spark, sf)).select("bin", r6("conf"), r6("acc"), "n")


@query(CONF + BINS + " SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece_equal_width(spark: SparkSession, sf: str) -> DataFrame:
    return m.calibration_error(m.calibration_bins(confident(spark, sf))).select(r6("ece"))


@query(CONF + ", t AS (SELECT *, ntile(15) OVER (ORDER BY conf, id) - 1 AS bin FROM r), b AS (SELECT bin, avg(conf) AS conf, avg(correct) AS acc, count(*) AS n FROM t GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return m.calibration_error(m.adaptive_bins(confident(spark, sf), "id")).select(r6("ece"))


CURVE = ", k AS (SELECT row_number() OVER w AS k, count(*) OVER () AS n, sum(1 - correct) OVER (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS e FROM r WINDOW w AS (ORDER BY conf DESC, id)), c AS (SELECT k, n, k::DOUBLE / n AS coverage, e / k AS risk FROM k)"


@query(CONF + CURVE + " SELECT k::INT AS k, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM c")
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return m.risk_coverage(confident(spark, sf)).select("k", r6("coverage"), r6("risk"))


@query(CONF + CURVE + ", a AS (SELECT (risk + lag(risk) OVER (ORDER BY k)) / 2 * (coverage - lag(coverage) OVER (ORDER BY k)) AS a FROM c) SELECT round(sum(a), 6) AS aurc FROM a")
def aurc(spark: SparkSession, sf: str) -> DataFrame:
    return m.aurc(m.risk_coverage(confident(spark, sf))).select(r6("aurc"))


@query(CONF + CURVE + " SELECT round(risk, 6) AS risk FROM c WHERE k = greatest(1, round_even(0.8 * n, 0)::INT)")
def risk_at_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return m.risk_at(m.risk_coverage(confident(spark, sf))).select(r6("risk"))


@query(CONF + ", p AS (SELECT conf, sum(correct) AS p, sum(1 - correct) AS q FROM r GROUP BY conf), u AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM p) SELECT round(sum(u) / (sum(p) * sum(q)), 6) AS auroc FROM u")
def conf_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return m.auroc(confident(spark, sf)).select(r6("auroc"))


ABSTAIN = "SELECT event_id % 5 = 0 AS p, event_type = 'error' AS g FROM events"


@query(f"WITH x AS ({ABSTAIN}) SELECT round(count_if(p AND g)::DOUBLE / count_if(p), 6) AS precision, round(count_if(p AND g)::DOUBLE / count_if(g), 6) AS recall, round(2e0 * count_if(p AND g) / (count_if(p) + count_if(g)), 6) AS f1 FROM x")
def abstention_prf(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select((F.col("event_id") % 5 == 0).alias("pred_abstain"), (F.col("event_type") == "error").alias("should_abstain"))
    return m.abstention_report(x).select(r6("precision"), r6("recall"), r6("f1"))


@query("SELECT round(avg(CASE WHEN event_id % 3 = 0 AND (json_extract(props, '$.k'))::DOUBLE / 100 >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS confident_wrong FROM events WHERE event_type = 'error'")
def confident_wrong(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select((F.col("event_type") == "error").alias("is_impossible"), (F.col("event_id") % 3 == 0).alias("gave_span"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"))
    return m.confident_wrong(x).select(r6("confident_wrong"))


LOGITS = "WITH r AS (SELECT (event_id * 7919 % 2001 - 1000) / 2e2 AS z, CASE WHEN event_id * 7919 % 2001 - 1000 + event_id % 700 > 0 THEN 1e0 ELSE 0e0 END AS y FROM events), b0 AS (SELECT -4e0 AS low, 4e0 AS high)"
FIT = "".join(
    f", g{k} AS (SELECT low + (high - low) * i / 32 AS t, (high - low) / 32 AS step FROM b{k - 1}, generate_series(0, 32) AS s(i)), p{k} AS (SELECT t, step, y, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-z / exp(t))))) AS p FROM r, g{k}), "
    f"n{k} AS (SELECT t, any_value(step) AS step, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS nll FROM p{k} GROUP BY t), b{k} AS (SELECT greatest(-4e0, t - step) AS low, least(4e0, t + step) AS high, t FROM n{k} ORDER BY nll, t LIMIT 1)"
    for k in range(1, 5)
)


@query(LOGITS + FIT + " SELECT round(exp(t), 4) AS temperature FROM b4")
def temperature_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The temperature of least negative log likelihood, by a grid that narrows four times."""
    k = F.col("event_id") * 7919 % 2001 - 1000
    x = table(spark, sf, "events").select((k / 200.0).alias("logit"), (k + F.col("event_id") % 700 > 0).cast("double").alias("correct"))
    return spark.createDataFrame([(round(m.temperature(x), 4),)], "temperature double")


GRID = [-1.0 + 0.25 * i for i in range(9)]


@query("WITH r AS (SELECT (event_id * 7919 % 2001 - 1000) / 2e2 AS z, CASE WHEN event_id * 7919 % 2001 - 1000 + event_id % 700 > 0 THEN 1e0 ELSE 0e0 END AS y FROM events), g(log_t) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in GRID) + "), p AS (SELECT log_t, y, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-z / exp(log_t))))) AS p FROM r, g) SELECT log_t, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll FROM p GROUP BY log_t")
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") * 7919 % 2001 - 1000
    x = table(spark, sf, "events").select((k / 200.0).alias("logit"), (k + F.col("event_id") % 700 > 0).cast("double").alias("correct"))
    return m.temperature_grid(x, GRID).select("log_t", r6("nll"))


POISSON = " + ".join(f"(u >= {t!r}::DOUBLE)::INT" for t in [sum(0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: k + 1]) for k in range(8)])


def drawn(unit: str, seed: int = 0) -> str:
    """The draw of a unit in resample ``rep``: a polynomial of it, whose coefficients are parts of one md5."""
    a, b, c = (f"('0x' || substr(md5('draw:{seed}:' || {unit}::VARCHAR), {1 + 7 * i}, 7))::BIGINT" for i in range(3))
    return f"(({a} + {b} * rep + {c} * rep * rep) % {m.PRIME}) / {m.PRIME}::DOUBLE"


#: The draw of a unit in resample ``rep`` by an md5 of both.
EACH = "('0x' || left(md5('draw:0:' || rep || ':' || event_id), 10))::BIGINT / 1099511627776e0"


@query(f"WITH x AS (SELECT value AS v, {EACH} AS u, rep FROM events, generate_series(0, 199) AS g(rep)), m AS (SELECT rep, sum(v * ({POISSON})) / sum({POISSON}) AS m FROM x GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return m.bootstrap_interval_independent(frames(spark, sf).select("event_id", F.col("value")), "value", "event_id", 200).select(r6("lo"), r6("hi"))


@query("SELECT round(avg(l_quantity), 6) AS prefill_ms, round(avg(l_extendedprice), 6) AS decode_ms, round(sum(l_linenumber) / (sum(l_extendedprice) / 1000), 6) AS tokens_s, round(max(l_tax), 6) AS peak_vram_gb, round((sum(l_quantity) + sum(l_extendedprice)) / 1000 / count(*), 6) AS gpu_s_per_q, round(avg(l_suppkey), 6) AS n_frames, round(avg(l_partkey), 6) AS n_vis_tokens, round(avg(l_orderkey), 6) AS ctx_len FROM lineitem")
def efficiency_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").selectExpr("l_quantity prefill_ms", "l_extendedprice decode_ms", "l_linenumber n_new_tokens", "l_tax peak_vram_gb", "l_suppkey n_frames", "l_partkey n_vis_tokens", "l_orderkey ctx_len")
    out = m.efficiency_report(x)
    return out.select(*[r6(c) for c in out.columns])
