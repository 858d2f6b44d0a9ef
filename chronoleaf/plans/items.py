"""Driver queries on splits, selections, task items, result tables and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.operators import metrics as m
from chronoleaf.operators import report, tasks
from chronoleaf.operators import selection as sel
from chronoleaf.operators import timeline as tl
from chronoleaf.plans.base import BUCKET, EDGES, KEYS, SQL, TIOU, frames, predicted, runs, stored, table
from chronoleaf.plans.intervals import span
from chronoleaf.sources import sinks

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


DRAWN = "md5('0:' || c_custkey::VARCHAR)"
SPLIT = f"WITH k AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAWN}, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), s AS (SELECT *, CASE WHEN k <= round_even(n * 0.6e0, 0) THEN 'train' WHEN k <= round_even(n * 0.6e0, 0) + round_even(n * 0.2e0, 0) THEN 'val' ELSE 'test' END AS split FROM k)"


def split(spark: SparkSession, sf: str) -> DataFrame:
    return sel.grouped_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey", "c_mktsegment")


@query(SPLIT + " SELECT c_custkey, c_mktsegment, split FROM s")
def split_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("c_custkey", "c_mktsegment", "split")


@query(SPLIT + " SELECT c_nationkey, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leak_check(spark: SparkSession, sf: str) -> DataFrame:
    return sel.split_leaks(split(spark, sf), "c_nationkey")


@query(SPLIT + " SELECT c_nationkey FROM s WHERE split = 'train' INTERSECT SELECT c_nationkey FROM s WHERE split = 'test'")
def center_leak(spark: SparkSession, sf: str) -> DataFrame:
    return sel.center_leaks(split(spark, sf), "c_nationkey")


@query("SELECT c_custkey, CASE ('0x' || left(md5('0:' || c_custkey::VARCHAR), 8))::BIGINT % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM customer")
def split_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return sel.hashed_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("WITH n AS (SELECT s_name, coalesce(try_cast(regexp_replace(s_name, '\\D', '', 'g') AS BIGINT), 0) AS n FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY n, s_name) AS k FROM n) SELECT s_name, CASE WHEN n > 40 THEN 'test' WHEN k <= 8 THEN 'val' ELSE 'train' END AS split FROM k")
def split_by_number(spark: SparkSession, sf: str) -> DataFrame:
    return sel.fixed_split(table(spark, sf, "supplier").select("s_name"), "s_name", "twinanda_40_40")


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def shuffled_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sel.shuffled_limit(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 3)


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"WITH s AS (SELECT q.vec_id AS query, e.vec_id AS item, round({DOT.format('q.embedding', 'e.embedding')} / (sqrt({DOT.format('q.embedding', 'q.embedding')}) * sqrt({DOT.format('e.embedding', 'e.embedding')})), 9) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) SELECT query, item, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 5")
def retrieve_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest rows of every row among all rows, in large blocks: the pairs grow with the square of the table."""
    e = table(spark, sf, "embeddings")
    x = sel.nearest(e, e, "vec_id", "vec_id", "embedding", 5, (1024, 2048))
    return x.select("query", "item", r6("score"), "rank")


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 25 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS item, round({DOT.format('q.embedding', 'e.embedding')} / (sqrt({DOT.format('q.embedding', 'q.embedding')}) * sqrt({DOT.format('e.embedding', 'e.embedding')})), 9) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) SELECT query, item, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 5")
def retrieve_topk_cosine_all(spark: SparkSession, sf: str) -> DataFrame:
    """The search of ``retrieve_topk_cosine`` for the rows whose id is divisible by 25."""
    e = table(spark, sf, "embeddings")
    x = sel.nearest(e.filter("vec_id % 25 = 0"), e, "vec_id", "vec_id", "embedding", 5)
    return x.select("query", "item", r6("score"), "rank")


@query("WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, rank::INT AS rank FROM k WHERE rank <= ceil(n * 0.25e0)")
def raft_top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return sel.top_fraction(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "rank")


@query("WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo FROM events) SELECT x.user_id, x.event_id AS chosen, y.event_id AS rejected, round(x.value - y.value, 6) AS margin FROM b x JOIN b y ON x.user_id = y.user_id AND x.hi = 1 AND y.lo = 1 WHERE x.value - y.value > 0.5")
def dpo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    x = sel.preference_pairs(table(spark, sf, "events"), "user_id", "event_id", "value", 0.5)
    return x.select("user_id", "chosen", "rejected", F.round(F.col("chosen_score") - F.col("rejected_score"), 6).alias("margin"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) SELECT l_orderkey, l_linenumber FROM w WHERE s <= 5000")
def keep_recent(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").withColumn("item", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return sel.keep_recent(x, "l_quantity", "l_shipdate", "item", 5000).select("l_orderkey", "l_linenumber")


@query("WITH t AS (SELECT o_custkey, o_orderkey, split_part(o_orderpriority, ' ', 1) AS tool FROM orders), f AS (SELECT o_custkey, arg_min(tool, o_orderkey) AS tool FROM t GROUP BY 1) SELECT o_custkey, tool, count(*) AS uses FROM t JOIN f USING (o_custkey, tool) GROUP BY ALL")
def qa_counting(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("label"))
    return tasks.tool_counts(x, ["o_custkey"])


def videos_and_timeline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vid = F.concat_ws("-", "user_id", "session")
    x = runs(spark, sf).select(F.lit("events").alias("dataset"), vid.alias("video_id"), F.lit("phase").alias("kind"), "run_id", F.lit(None).cast("int").alias("label_id"), "label", "t0", "t1")
    return videos_of(x), x


def videos_of(timeline: DataFrame) -> DataFrame:
    v = timeline.groupBy("dataset", "video_id").agg(F.max("t1").alias("duration_s"))
    return v.withColumn("domain", F.lit("log")).withColumn("center", F.lit(None).cast("string"))


def stored_videos_and_timeline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The timeline is made once, videos come from what is stored of it."""
    timeline = stored(videos_and_timeline(spark, sf)[1], "timeline")
    return stored(videos_of(timeline), "videos"), timeline


@query(SQL + """, l AS (SELECT user_id, session, label, count(*) AS n FROM runs GROUP BY ALL), k AS (SELECT user_id, session, count(*) AS n FROM runs GROUP BY ALL)
SELECT 't1' AS task, CASE WHEN n > 1 THEN 'phase_multi' ELSE 'phase' END AS sub_type, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT 't1', 'relative', count(*) FROM k WHERE n >= 2 UNION ALL SELECT 't1', 'unanswerable', count(*) FROM k UNION ALL SELECT 't1', 'contradiction', count(*) FROM k
UNION ALL SELECT 't2', 'phase', count(*) FROM k UNION ALL SELECT 't3', 'rsd', sum(greatest(0, ceil(dur / 300e0) - 1))::BIGINT FROM procs
UNION ALL SELECT 't5', 'ordering', count(*) FROM k WHERE n >= 2 UNION ALL SELECT 't5', 'duration', count(*) FROM k WHERE n >= 2 UNION ALL SELECT 't6', 'interval', count(*) FROM k WHERE n >= 2""")
def task_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.histogram(tasks.build(*stored_videos_and_timeline(spark, sf), list(EDGES)))


@query(SQL + "SELECT user_id || '-' || session AS video_id, label, count(*)::INT AS n_spans, round(min(t0), 1) AS t0 FROM runs GROUP BY user_id, session, label")
def grounding_items(spark: SparkSession, sf: str) -> DataFrame:
    x = tasks.grounding_items(*videos_and_timeline(spark, sf), "phase")
    label = F.regexp_extract(F.element_at("messages", 2)["content"], r"When is the (\w+) performed", 1)
    return x.select("video_id", label.alias("label"), F.size("target.spans").alias("n_spans"), F.col("target.spans")[0]["t0"].alias("t0"))


@query(SQL + "SELECT user_id || '-' || session AS video_id, string_agg(label, ',' ORDER BY run_id) AS labels, count(*)::INT AS n FROM runs GROUP BY user_id, session")
def segment_items(spark: SparkSession, sf: str) -> DataFrame:
    x = tasks.segmentation_items(*videos_and_timeline(spark, sf), "phase")
    return x.select("video_id", F.array_join("target.labels", ",").alias("labels"), F.size("target.segments").alias("n"))


@query(SQL + "SELECT user_id || '-' || session AS video_id, i * 300e0 AS probe_t_s, CASE WHEN dur < 2700 THEN 'short' WHEN dur >= 7200 THEN 'retrieve' ELSE 'hier' END AS regime FROM procs, generate_series(1, (ceil(dur / 300e0) - 1)::BIGINT) AS g(i) WHERE ceil(dur / 300e0) - 1 >= 1")
def rsd_items(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = videos_and_timeline(spark, sf)
    return tasks.duration_items(v).select("video_id", "probe_t_s", "regime")


@query(SQL + "SELECT user_id || '-' || session AS video_id, arg_min(label, run_id) AS answer FROM runs GROUP BY user_id, session HAVING count(*) >= 2")
def qa_ordering_items(spark: SparkSession, sf: str) -> DataFrame:
    x = tasks.qa_items(*videos_and_timeline(spark, sf)).filter("sub_type = 'ordering'")
    return x.select("video_id", F.col("target.answer").alias("answer"))


@query()
def task_items(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.build(*stored_videos_and_timeline(spark, sf), list(EDGES)).select("id", "task", "sub_type", "regime", F.size("messages").alias("n_messages"))


IOUS = SQL + f", x AS (SELECT label, {TIOU.format('p0', 'p1', 't0', 't1')} AS iou, {BUCKET.format('dur')} AS b FROM runs JOIN procs USING (user_id, session)), c AS (SELECT label, b, round(avg(iou), 6) AS miou, count(*)::DOUBLE AS n FROM x GROUP BY ALL UNION ALL SELECT label, 'overall', round(avg(iou), 6), count(*) FROM x GROUP BY ALL)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    x = predicted(runs(spark, sf))
    x = m.grounding_scores(x.join(tl.durations(x, KEYS), KEYS).select("label", span("p0", "p1").alias("pred_spans"), span("t0", "t1").alias("gt_spans"), "duration_s"))
    one = F.map_from_arrays(F.array(F.lit("miou"), F.lit("n")), F.array(F.round(F.avg("iou"), 6), F.count(F.lit(1)).cast("double")))
    by = x.groupBy("label", "len_bucket").agg(one.alias("v")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("len_bucket", "v"))).alias("by_length"))
    return x.groupBy("label").agg(one.alias("metrics")).join(by, "label").withColumnRenamed("label", "method").withColumn("provenance", F.create_map(F.lit("seed"), F.lit("0")))


@query(IOUS + " SELECT label AS method, b AS len_bucket, miou, n AS n_items, '0' AS seed FROM c")
def metric_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return report.flatten(cells(spark, sf)).select("method", "len_bucket", "miou", "n_items", "seed")


@query(IOUS + " SELECT label AS method, max(miou) FILTER (WHERE b = 'overall') AS overall, max(miou) FILTER (WHERE b = '<30min') AS b30, max(miou) FILTER (WHERE b = '30-60min') AS b60, max(miou) FILTER (WHERE b = '60-120min') AS b120, max(miou) FILTER (WHERE b = '>120min') AS b999 FROM c GROUP BY 1")
def metric_pivot_by_length(spark: SparkSession, sf: str) -> DataFrame:
    x = report.pivot_by_length(report.flatten(cells(spark, sf)), "miou", ["method"])
    return x.withColumnsRenamed({"<30min": "b30", "30-60min": "b60", "60-120min": "b120", ">120min": "b999"})


@query(IOUS + " SELECT label AS method, b AS len_bucket, 'miou' AS metric, miou AS value FROM c UNION ALL SELECT label, b, 'n', n FROM c")
def metric_long(spark: SparkSession, sf: str) -> DataFrame:
    return report.long_metrics(cells(spark, sf)).select("method", "len_bucket", "metric", "value")


@query("SELECT event_id, user_id FROM events")
def shard_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    shards = sinks.pack_shards(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 0.05)
    x = sinks.unpack_shards(shards).select(F.from_json("json", "event_id long, user_id long").alias("r"))
    return x.select("r.*")


@query(SQL + "SELECT label, count(*) AS n, round(avg(t), 6) AS mean_t FROM frames WHERE t BETWEEN 60 AND 7200 GROUP BY 1")
def frames_in_window(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).filter(F.col("t").between(60, 7200))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t"), 6).alias("mean_t"))


VID = "user_id || '-' || session"
NTH = ", k AS (SELECT *, " + VID + " AS vid, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, session) AS n, lead(t0) OVER w AS next_t0, lead(t1) OVER w AS next_t1, lead(t1, 2) OVER w AS end2, max(run_id) OVER (PARTITION BY user_id, session) AS top FROM runs WINDOW w AS (PARTITION BY user_id, session ORDER BY run_id))"


def picked(n: str, *parts: str) -> str:
    """SQL of ``tasks.pick`` with seed 0."""
    return f"('0x' || left(md5('0:' || {' || chr(58) || '.join(parts)}), 12))::BIGINT % ({n})"


def asked() -> Column:
    """The question of an item."""
    return F.element_at("messages", 2)["content"]


@query(SQL + NTH + f" SELECT vid AS video_id, label, round(next_t0, 1) AS t0, round(next_t1, 1) AS t1 FROM k WHERE n > 1 AND k - 1 = {picked('n - 1', repr('relative'), 'vid')}")
def relative_items(spark: SparkSession, sf: str) -> DataFrame:
    """What follows a drawn phase."""
    x = tasks.relative_items(*videos_and_timeline(spark, sf))
    s = F.col("target.spans")[0]
    return x.select("video_id", F.regexp_extract(asked(), r"right after the (\w+)\?", 1).alias("label"), s["t0"].alias("t0"), s["t1"].alias("t1"))


@query(SQL + ", q AS (SELECT " + VID + " AS vid, dur, i FROM procs, generate_series(1, 3) AS g(i)), w AS (SELECT vid, dur, round(greatest(0e0, dur - 300) * (('0x' || left(md5('0:window:' || vid || ':' || i), 8))::BIGINT / 4294967296e0), 1) AS w0, i FROM q), x AS (SELECT *, least(dur, w0 + 300) AS w1 FROM w), "
    + "o AS (SELECT x.vid, x.i, label, min(run_id) AS f FROM x JOIN runs ON " + VID + " = x.vid AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL), l AS (SELECT vid, i, string_agg(label, ',' ORDER BY f, label) AS labels FROM o GROUP BY ALL) SELECT x.vid AS video_id, round(w0, 1) AS w0, round(w1, 1) AS w1, coalesce(labels, '') AS labels FROM x LEFT JOIN l USING (vid, i)")
def detection_items(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn windows and what is active in them."""
    x = tasks.detection_items(*videos_and_timeline(spark, sf), "phase")
    w = F.col("target.window")
    return x.select("video_id", F.round(w[0], 1).alias("w0"), F.round(w[1], 1).alias("w1"), F.array_join("target.labels", ",").alias("labels"))


@query(SQL + NTH + f" SELECT vid AS video_id, label, round((t1 - t0) / 60e0, 2) AS minutes FROM k WHERE n >= 2 AND k - 1 = {picked('n', repr('duration'), 'vid')}")
def qa_duration_items(spark: SparkSession, sf: str) -> DataFrame:
    """How long a drawn phase lasts."""
    x = tasks.qa_items(*videos_and_timeline(spark, sf)).filter("sub_type = 'duration'")
    return x.select("video_id", F.regexp_extract(asked(), r"does the (\w+) last", 1).alias("label"), F.col("target.minutes").alias("minutes"))


@query(SQL + NTH + f", s AS (SELECT vid, t0 AS w0, coalesce(end2, (SELECT t1 FROM runs r WHERE r.user_id = k.user_id AND r.session = k.session AND r.run_id = k.top)) AS w1 FROM k WHERE n > 1 AND k - 1 = {picked('n - 1', repr('summary'), 'vid')}) SELECT vid AS video_id, round(w0, 1) AS w0, round(w1, 1) AS w1, string_agg(label, ',' ORDER BY run_id) AS labels FROM s JOIN runs ON {VID} = vid AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL")
def summary_items(spark: SparkSession, sf: str) -> DataFrame:
    """A drawn phase to the end of the second one after it."""
    x = tasks.summary_items(*videos_and_timeline(spark, sf))
    w, labels = F.col("frames.window"), F.transform("target.timeline", lambda s: s["label"])
    return x.select("video_id", F.round(w[0], 1).alias("w0"), F.round(w[1], 1).alias("w1"), F.array_join(labels, ",").alias("labels"))


ASKED = "['" + "', '".join(tasks.ABSENT) + "'][1 + " + picked(str(len(tasks.ABSENT)), "'absent'", "vid") + "]"
EDGE = picked(str(len(EDGES)), "'edge'", "vid")
BEFORE, AFTER = ("['" + "', '".join(e[k] for e in EDGES) + f"'][1 + {EDGE}]" for k in (0, 1))


@query(SQL + f", v AS (SELECT {VID} AS vid FROM procs) SELECT vid AS video_id, 'unanswerable' AS sub_type, 'When is ' || {ASKED} || ' performed?' AS question FROM v UNION ALL SELECT vid, 'contradiction', 'After the ' || {AFTER} || ', when is the ' || {BEFORE} || ' performed?' FROM v")
def unanswerable_items(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about what is absent, and about what the graph rules out."""
    v, _ = videos_and_timeline(spark, sf)
    x = tasks.unanswerable_items(v, list(EDGES)).filter("target.abstain")
    return x.select("video_id", "sub_type", F.substring_index(asked(), "\n", -1).alias("question"))


@query(SQL + NTH + ", p(label, parent) AS (VALUES ('view', 'looking'), ('click', 'acting')) SELECT vid AS video_id, parent, label, round(t0, 1) AS t0, round(t1, 1) AS t1 FROM k JOIN p USING (label) WHERE k = 1")
def cross_scale_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of a video within its phase; runs stand in for steps."""
    v, t = videos_and_timeline(spark, sf)
    steps = spark.createDataFrame([("view", "looking"), ("click", "acting"), ("error", None)], "name string, parent string")
    x = tasks.cross_scale_items(v, t.withColumn("kind", F.lit("step")), steps)
    s = F.col("target.spans")[0]
    return x.select("video_id", F.regexp_extract(asked(), r"During the (\w+),", 1).alias("parent"), F.regexp_extract(asked(), r"when is (\w+) performed", 1).alias("label"), s["t0"].alias("t0"), s["t1"].alias("t1"))
