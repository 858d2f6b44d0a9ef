"""Driver queries on the answer grammar, question answering, judges, chat text and paraphrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.functions import intervals as iv
from chronoleaf.functions import text as tx
from chronoleaf.operators import metrics as m
from chronoleaf.operators import selection as sel
from chronoleaf.operators import timeline as tl
from chronoleaf.plans.base import KEYS, SQL, predicted, runs, table

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


def shown(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the answer text of their predicted span, an abstention for every fifth, noise for every seventh."""
    x = predicted(runs(spark, sf))
    text = an.answer_spans(F.array(F.struct(F.col("p0").alias("t0"), F.col("p1").alias("t1"))), confidence=F.col("run_id") % 100)
    return x.withColumn("text", F.when(F.col("run_id") % 7 == 0, "no idea").when(F.col("run_id") % 5 == 0, "<answer>ABSTAIN</answer>").otherwise(text))


KIND = "CASE WHEN run_id % 7 = 0 THEN 'bad' WHEN run_id % 5 = 0 THEN 'abstain' ELSE 'span' END"


@query(SQL + f"SELECT user_id, session, run_id, {KIND} AS kind, CASE WHEN {KIND} = 'span' THEN round(greatest(0e0, p0), 1) END AS t0, CASE WHEN {KIND} = 'span' THEN round(greatest(0e0, p1), 1) END AS t1, CASE WHEN {KIND} = 'span' THEN CASE WHEN run_id % 100 > 1 THEN run_id % 100 / 1e2 ELSE run_id % 100 END END AS conf FROM runs")
def parse_spans(spark: SparkSession, sf: str) -> DataFrame:
    x = shown(spark, sf).withColumn("p", an.parse_answer(F.col("text")))
    return x.select("user_id", "session", "run_id", F.col("p.kind").alias("kind"), F.get("p.spans", F.lit(0))["t0"].alias("t0"), F.get("p.spans", F.lit(0))["t1"].alias("t1"), an.parse_confidence(F.col("text")).alias("conf"))


@query(SQL + "SELECT user_id, session, run_id, label, round(t0, 1) AS t0, round(t1, 1) AS t1 FROM runs")
def parse_segments(spark: SparkSession, sf: str) -> DataFrame:
    x = runs(spark, sf).groupBy("user_id", "session").agg(F.array_sort(F.collect_list(F.struct("run_id", "label", "t0", "t1"))).alias("s"))
    x = x.withColumn("text", an.answer_segments(F.transform("s", lambda r: F.struct(r["label"].alias("label"), r["t0"].alias("t0"), r["t1"].alias("t1")))))
    x = x.select("user_id", "session", F.posexplode(an.parse_segments(F.col("text"))).alias("i", "g"))
    return x.select("user_id", "session", (F.col("i") + 1).cast("long").alias("run_id"), "g.label", "g.t0", "g.t1")


@query("SELECT event_id, round(event_id % 900 / 1e1, 1) AS minutes, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END AS n_labels, (event_id % 100) * 60e0 + event_id % 60 AS seconds FROM events")
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    minutes = F.concat(F.lit("about "), F.format_string("%.1f", F.col("event_id") % 900 / 10.0), F.lit(" minutes"))
    labels = F.when(F.col("event_id") % 4 == 0, "<answer>None</answer>").otherwise("<answer>clip ; cut,</answer>")
    stamp = F.format_string("%02d:%02d", F.col("event_id") % 100, F.col("event_id") % 60)
    return e.select("event_id", an.parse_minutes(minutes).alias("minutes"), F.size(an.parse_labels(labels)).alias("n_labels"), an.parse_ts(stamp).alias("seconds"))


NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"


@query(f"SELECT doc_id, md5(array_to_string({NORM.format('text')}, ' ')) AS digest FROM documents")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


PAIRS = "WITH c AS (SELECT conv_id, turn, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations)"


@query(PAIRS + f""", t AS (SELECT {NORM.format('pred')} AS p, {NORM.format('gold')} AS g FROM c WHERE gold IS NOT NULL),
s AS (SELECT p, g, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same FROM t)
SELECT round(avg(CASE WHEN p = g THEN 1e0 ELSE 0e0 END), 6) AS em, round(avg(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1e0 WHEN same = 0 THEN 0e0 ELSE 2e0 * same / (len(p) + len(g)) END), 6) AS f1, count(*) AS n FROM s""")
def qa_em_f1(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select(F.col("text").alias("pred"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("gold"))
    return m.qa_report(c.filter("gold is not null")).select(r6("em"), r6("f1"), "n")


SAID = ("Correct.", "partial credit", "This is WRONG", "incorrect", "no idea")


@query("WITH v AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' WHEN 3 THEN 'incorrect' ELSE 'wrong' END AS v FROM documents) SELECT round(avg(CASE v WHEN 'correct' THEN 1e0 WHEN 'partial' THEN 0.5e0 ELSE 0e0 END), 6) AS judge, round(avg((v = 'correct')::INT), 6) AS correct, round(avg((v = 'partial')::INT), 6) AS partial, round(avg((v IN ('wrong', 'incorrect'))::INT), 6) AS wrong, count(*) AS n FROM v")
def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select(F.get(F.array(*[F.lit(s) for s in SAID]), (F.col("doc_id") % 5).cast("int")).alias("verdict"))
    out = m.judge_report(x)
    return out.select(*[r6(c) for c in out.columns if c != "n"], "n")


@query("""WITH c AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS chat, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS said, min(turn) FILTER (WHERE role = 'assistant') AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(chat) AS digest, CASE WHEN k IS NULL THEN 0 ELSE strpos(chat, said) - 1 END::INT AS start, CASE WHEN k IS NULL THEN 0 ELSE strpos(chat, said) - 1 + length(said) END::INT AS stop FROM c""")
def chat_render(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    msgs = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    x = c.select("conv_id", msgs.alias("m")).withColumn("s", an.assistant_span(F.col("m")))
    return x.select("conv_id", F.md5(an.plain_chat(F.col("m"))).alias("digest"), "s.start", "s.stop")


@query("""WITH c AS (SELECT left(sha1('t5' || chr(31) || item_id::VARCHAR), 16) AS key, max(CASE WHEN item_id % 7 = 0 THEN ' ' ELSE left(text, 20) END) AS p FROM benchmark GROUP BY 1),
d AS (SELECT doc_id, left(sha1('t5' || chr(31) || (doc_id % 50)::VARCHAR), 16) AS key, 'question ' || doc_id AS q FROM documents)
SELECT doc_id, coalesce(nullif(trim(p), ''), q) AS q FROM d LEFT JOIN c USING (key)""")
def paraphrase_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cache = table(spark, sf, "benchmark").select(an.cache_key(F.lit("t5"), F.col("item_id").cast("string")).alias("key"), F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.left("text", F.lit(20))).alias("paraphrase"))
    d = table(spark, sf, "documents").select("doc_id", an.cache_key(F.lit("t5"), (F.col("doc_id") % 50).cast("string")).alias("key"), F.concat(F.lit("question "), F.col("doc_id")).alias("q"))
    return sel.paraphrased(d, cache, "key", "q").select("doc_id", "q")


NAMES = ("the", "of", "and", "inst", "ti")
RANKS = ", ".join(f"('{x}', {i})" for i, x in enumerate(NAMES))


@query(f"""WITH h AS (SELECT doc_id, strpos(lower(text), n.name) AS pos, n.name, n.rank FROM documents, (VALUES {RANKS}) AS n(name, rank)), s AS (SELECT * FROM h WHERE pos > 0),
p AS (SELECT a.doc_id, count(*) AS inversions, count_if(b.name = 'the' AND a.name = 'ti') AS hard FROM s a JOIN s b ON a.doc_id = b.doc_id AND (a.pos, a.name) < (b.pos, b.name) AND a.rank > b.rank GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_mentioned, coalesce(inversions, 0) AS inversions, round(coalesce(inversions / nullif(n * (n - 1) / 2, 0), 0), 6) AS violation_rate, coalesce(hard, 0) AS hard, round(coalesce(n, 0) / 5e0, 6) AS coverage FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)""")
def summary_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("pred"), F.array(*[F.lit(x) for x in NAMES]).alias("names"))
    reach = spark.createDataFrame([("the", "ti")], "a string, b string")
    x = m.order_scores(d, reach, ["doc_id"])
    return x.select("doc_id", "n_mentioned", F.col("inversions").cast("long").alias("inversions"), r6("violation_rate"), F.col("hard").cast("long").alias("hard"), r6("coverage"))


@query("SELECT doc_id, length(text) + 36 AS n FROM documents")
def expand_media(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", an.expand_media(F.concat(F.lit("see <video> "), F.col("text")), 4).alias("t"))
    return x.select("doc_id", F.length("t").cast("long").alias("n")).withColumn("n", F.col("n") + 3)


RUBRIC = "Say whether the answer means the same."


@query(PAIRS + f" SELECT conv_id, turn, md5('{RUBRIC}' || chr(10) || chr(10) || 'QUESTION: about ' || conv_id || chr(10) || 'REFERENCE: ' || gold || chr(10) || 'ANSWER: ' || trim(pred) || chr(10) || chr(10) || 'VERDICT:') AS digest FROM c WHERE gold IS NOT NULL")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole prompts for a judge of answers."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("pred"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("gold")).filter("gold is not null")
    text = an.judge_prompt(RUBRIC, F.concat(F.lit("about "), F.col("conv_id")), F.col("gold"), F.col("pred"))
    return c.select("conv_id", "turn", F.md5(text).alias("digest"))


@query(SQL + f"SELECT user_id, session, md5('{RUBRIC}' || chr(10) || chr(10) || 'TIMELINE: ' || string_agg(label || ' [' || printf('%.0f', t0) || '-' || printf('%.0f', t1) || 's]', '; ' ORDER BY run_id) || chr(10) || 'SUMMARY: first ' || arg_min(label, run_id) || chr(10) || chr(10) || 'VERDICT:') AS digest FROM runs GROUP BY ALL")
def summary_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole prompts for a judge of summaries, with timelines as text."""
    x = runs(spark, sf).groupBy("user_id", "session").agg(F.array_sort(F.collect_list(F.struct("run_id", "label", "t0", "t1"))).alias("r"))
    text = an.summary_prompt(RUBRIC, F.col("r"), F.concat(F.lit("first "), F.col("r")[0]["label"]))
    return x.select("user_id", "session", F.md5(text).alias("digest"))


@query(SQL + "SELECT user_id, session, run_id, md5('Frames sampled at t = [' || array_to_string(list_transform(range(0, 5), lambda i: printf('%.1f', round(t0 + i * ((t1 - t0) / 4), 1))), ', ') || '] s of a ' || printf('%.0f', dur) || ' s procedure.' || chr(10) || '<video>' || chr(10) || 'When is the ' || label || ' performed?') AS digest FROM runs JOIN procs USING (user_id, session) WHERE t1 > t0")
def grounding_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole prompts that ask for a span, with the times of their frames."""
    x = runs(spark, sf)
    x = x.join(tl.durations(x, KEYS), KEYS).filter("t1 > t0")
    text = an.user_grounding(iv.sample_times(F.col("t0"), F.col("t1"), 5), F.col("duration_s"), F.concat(F.lit("When is the "), F.col("label"), F.lit(" performed?")))
    return x.select(*KEYS, "run_id", F.md5(text).alias("digest"))
