"""How the driver's tables stand in for videos: sessions of a user are procedures, events are frames, types are labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.operators.store import scratch, stored  # noqa: F401  plan modules take them from here
from chronoleaf.operators.timeline import collapse_runs, durations, sessionize

KEYS = ["user_id", "session"]
LABELS = ("click", "error", "purchase", "signup", "view")
#: a must come before b.
EDGES = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("error", "purchase"))
GAP_S = 6 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("label"), "value", "props", "ts")
    return sessionize(ev, "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), GAP_S).drop("ts")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(frames(spark, sf_dir), KEYS, "t", "label", 1.0, ["event_id"])


def shift(unit: str = "run_id"):
    """A whole per cent from -10 to 10 that moves a prediction away from its run."""
    return (F.col("user_id") * 31 + F.col("session") * 17 + F.col(unit) * 37) % 21 - 10


def predicted(timeline: DataFrame) -> DataFrame:
    """Runs with p0, p1: their span moved by ``shift`` per cent of its length."""
    by = (F.col("t1") - F.col("t0")) * shift() / 100
    return timeline.withColumn("p0", F.col("t0") + by).withColumn("p1", F.col("t1") + by)


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durations(runs(spark, sf_dir), KEYS)


SQL = """WITH ev AS (SELECT event_id, user_id, event_type AS label, value, props, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
se AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM ev),
frames AS (SELECT event_id, user_id, session, label, value, props, (us - min(us) OVER (PARTITION BY user_id, session)) / 1e6 AS t FROM se),
ch AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id, session ORDER BY t, event_id) THEN 1 ELSE 0 END AS c FROM frames),
rr AS (SELECT *, sum(c) OVER (PARTITION BY user_id, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM ch),
ru AS (SELECT user_id, session, run_id, min(label) AS label, min(t) AS t0, max(t) AS tl, count(*) AS n_frames FROM rr GROUP BY user_id, session, run_id),
rs AS (SELECT *, coalesce(lead(t0) OVER (PARTITION BY user_id, session ORDER BY run_id), tl + 1e0) AS t1 FROM ru),
runs AS (SELECT *, t0 + (t1 - t0) * ((user_id * 31 + session * 17 + run_id * 37) % 21 - 10) / 1e2 AS p0, t1 + (t1 - t0) * ((user_id * 31 + session * 17 + run_id * 37) % 21 - 10) / 1e2 AS p1 FROM rs),
procs AS (SELECT user_id, session, max(t1) AS dur FROM runs GROUP BY user_id, session)
"""

BUCKET = "CASE WHEN {0} / 60.0 < 30 THEN '<30min' WHEN {0} / 60.0 < 60 THEN '30-60min' WHEN {0} / 60.0 < 120 THEN '60-120min' ELSE '>120min' END"
TIOU = "CASE WHEN ({1}-{0})+({3}-{2})-greatest(0e0, least({1},{3})-greatest({0},{2})) > 0 THEN greatest(0e0, least({1},{3})-greatest({0},{2})) / (({1}-{0})+({3}-{2})-greatest(0e0, least({1},{3})-greatest({0},{2}))) ELSE 0e0 END"
EDGE_SQL = "edges(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ")"
