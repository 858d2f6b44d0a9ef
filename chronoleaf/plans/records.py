"""Driver queries on whole item records, rewritten questions, reports, stamps and tolerant reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.functions import text as tx
from chronoleaf.functions.intervals import TOOL_WORDS
from chronoleaf.operators import metrics as m
from chronoleaf.operators import provenance, report, tasks
from chronoleaf.plans import files, items
from chronoleaf.plans.base import EDGES, SQL, runs, scratch, table
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


#: Steps within phases of the records below; runs of every second number stand in for steps, of every third for actions.
PARENTS = (("view", "looking"), ("click", "acting"))
N = tasks.N_FRAMES


def ts(x: str) -> str:
    """SQL of ``answers.format_ts``."""
    return f"printf('%.1f', round(greatest(0e0, {x}), 1))"


def span(a: str, b: str) -> str:
    return f"'[' || {ts(a)} || ', ' || {ts(b)} || ']'"


def answer(inner: str) -> str:
    return f"'<answer>' || {inner} || '</answer>'"


def family(task: str, sub: str, source: str, request: str, said: str, goal: str, q: str = "''", window: tuple[str, str] | None = None, probe: str = "NULL") -> str:
    """SQL of the items of a family: what differs between families. request is null where remaining time is asked for."""
    a, b = window or ("0e0", "dur")
    return f"SELECT vid, dur, '{task}' AS task, {sub} AS sub_type, {q} AS q, {a} AS a, {b} AS b, {probe}::DOUBLE AS probe_t_s, {request} AS request, {said} AS said, {goal} AS goal FROM {source}"


def goal(spans: str = "''", labels: str = "''", minutes: str = "''", text: str = "''", answer: str = "''", count: str = "''", window: str = "''", abstain: str = "'false'") -> str:
    return " || '|' || ".join((spans, labels, minutes, text, answer, count, window, abstain))


SYSTEM = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tasks.SYSTEM.items()) + " END"
REGIME = "CASE WHEN dur < 2700 THEN 'short' WHEN dur >= 7200" + "".join(f" OR contains(lower(q), '{w}')" for w in TOOL_WORDS) + " THEN 'retrieve' ELSE 'hier' END"
GRID = f"CASE WHEN b > a THEN array_to_string(list_transform(range(0, {N}), lambda i: printf('%.1f', round(a + i * ((b - a) / {N - 1}), 1))), ', ') ELSE printf('%.1f', round(a, 1)) END"
ASK = "'When is the ' || label || ' performed?'"
OCCUR = "'When does ''' || label || ''' occur?'"
ONE, TURN = span("t0", "t1"), span("next_t0", "next_t1")
MINUTES = "printf('%.1f', round((t1 - t0) / 60e0, 1))"
FIRST = "(SELECT *, row_number() OVER (PARTITION BY vid ORDER BY run_id) AS j FROM tl JOIN (VALUES ('view', 'looking'), ('click', 'acting')) AS p(label, parent) USING (label) WHERE kind = 'step' AND run_id = (SELECT min(run_id) FROM tl AS f WHERE f.kind = 'step' AND f.vid = tl.vid))"
PARTS = (
    family("t1", "CASE WHEN n > 1 THEN 'phase_multi' ELSE 'phase' END", "sp WHERE kind = 'phase'", ASK, answer("every"), goal("goals"), ASK),
    family("t1", "'step'", "sp WHERE kind = 'step'", ASK, answer("one"), goal("lone"), ASK),
    family("t1", "'action'", "sp WHERE kind = 'action'", OCCUR, answer("every"), goal("goals"), OCCUR),
    family("t1", "'relative'", "k WHERE n > 1 AND k - 1 = " + items.picked("n - 1", "'relative'", "vid"), "'What happens right after the ' || label || '?'", answer(TURN), goal(TURN), "'What happens right after the ' || label || '?'"),
    family("t1", "'cross_scale'", FIRST, "'During the ' || parent || ', when is ' || label || ' performed?'", answer(ONE), goal(ONE), "'During the ' || parent || ', when is ' || label || ' performed?'"),
    family("t1", "'unanswerable'", "pr", f"'When is ' || {items.ASKED} || ' performed?'", answer("'ABSTAIN'"), goal(abstain="'true'"), f"'When is ' || {items.ASKED} || ' performed?'"),
    family("t1", "'contradiction'", "pr", f"'After the ' || {items.AFTER} || ', when is the ' || {items.BEFORE} || ' performed?'", answer("'ABSTAIN'"), goal(abstain="'true'"), f"'After the ' || {items.AFTER} || ', when is the ' || {items.BEFORE} || ' performed?'"),
    family("t2", "kind", "sg", "'Segment this operation into ' || kind || 's.'", answer("segs"), goal("goals", "labels")),
    family("t3", "'rsd'", "(SELECT *, i * 300e0 AS tick FROM pr, generate_series(1, (ceil(dur / 300e0) - 1)::BIGINT) AS g(i)) AS p", "NULL", answer("printf('%.1f', round((dur - tick) / 60e0, 1))"), goal(minutes="printf('%.2f', round((dur - tick) / 60e0, 2))"), window=("0e0", "tick"), probe="tick"),
    family("t4", "'steps'", "dt", f"'List the active steps in ' || {ts('w0')} || '-' || {ts('w1')} || ' s.'", answer("coalesce(labels, 'none')"), goal(labels="coalesce(replace(labels, ', ', ','), '')", window="printf('%.1f', round(w0, 1)) || '-' || printf('%.1f', round(w1, 1))"), window=("w0", "w1")),
    family("t5", "'ordering'", "k WHERE k = 1 AND n > 1", "'Which comes first, the ' || label || ' or the ' || next_label || '?'", answer("label"), goal(text="label", answer="label"), "'Which comes first, the ' || label || ' or the ' || next_label || '?'"),
    family("t5", "'duration'", "k WHERE n > 1 AND k - 1 = " + items.picked("n", "'duration'", "vid"), "'How many minutes does the ' || label || ' last?'", answer(MINUTES), goal(minutes="printf('%.2f', round((t1 - t0) / 60e0, 2))", text=MINUTES, answer=MINUTES), "'How many minutes does the ' || label || ' last?'"),
    family("t5", "'counting'", "ct", "'How many times is the ' || tool || ' used?'", answer("uses"), goal(text="uses", answer="uses", count="uses"), "'How many times is the ' || tool || ' used?'"),
    family("t6", "'interval'", "su", f"'Summarize ' || {ts('w0')} || '-' || {ts('w1')} || ' s of this operation.'", answer("told"), goal(text="told"), window=("w0", "w1")),
)
VID = "user_id || '-' || session"
#: What stands for steps and actions, and nothing of either.
THREE = "SELECT 'phase' AS kind, * FROM ph UNION ALL SELECT 'step', * FROM ph WHERE run_id % 2 = 0 UNION ALL SELECT 'action', * FROM ph WHERE run_id % 3 = 0"
PHASES = "SELECT 'phase' AS kind, * FROM ph"
ID = "'events-' || vid || '-' || task || '-' || lpad((row_number() OVER (PARTITION BY vid, task ORDER BY sub_type, probe_t_s, asked))::VARCHAR, 6, '0') AS id"
WHOLE = f"{ID}, sub_type, {REGIME} AS regime, round(probe_t_s, 1) AS probe_t_s, md5(grid) AS frames, md5('system:' || {SYSTEM} || chr(10) || 'user:' || asked || chr(10) || 'assistant:' || said) AS messages, md5(goal) AS target"


def records_sql(timeline: str, columns: str) -> str:
    return f"""{SQL}, pr AS (SELECT *, {VID} AS vid FROM procs), ph AS (SELECT vid, dur, run_id, label, t0, t1 FROM runs JOIN pr USING (user_id, session)),
tl AS ({timeline}),
ls AS (SELECT kind, vid, dur, label, count(*) AS n, string_agg({ONE}, ', ' ORDER BY t0, t1) AS goals, arg_min({ONE}, run_id) AS lone FROM tl WHERE kind <> 'action' OR t1 - t0 >= 2 GROUP BY ALL),
sp AS (SELECT *, CASE WHEN n > 1 THEN '[' || goals || ']' ELSE goals END AS every, lone AS one FROM ls),
sg AS (SELECT kind, vid, dur, '[' || string_agg('["' || label || '", ' || {ts('t0')} || ', ' || {ts('t1')} || ']', ', ' ORDER BY run_id) || ']' AS segs, string_agg({ONE}, ', ' ORDER BY run_id) AS goals, string_agg(label, ',' ORDER BY run_id) AS labels FROM tl WHERE kind <> 'action' GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY vid) AS n, lead(label) OVER w AS next_label, lead(t0) OVER w AS next_t0, lead(t1) OVER w AS next_t1, lead(t1, 2) OVER w AS end2, last_value(t1) OVER (PARTITION BY vid ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM ph WINDOW w AS (PARTITION BY vid ORDER BY run_id)),
dw AS (SELECT vid, dur, i, round(greatest(0e0, dur - 300) * (('0x' || left(md5('0:window:' || vid || ':' || i), 8))::BIGINT / 4294967296e0), 1) AS w0, least(dur, w0 + 300) AS w1 FROM pr, generate_series(1, 3) AS g(i) WHERE vid IN (SELECT vid FROM tl WHERE kind = 'step')),
da AS (SELECT vid, i, label, min(run_id) AS f FROM dw JOIN tl USING (vid) WHERE kind = 'step' AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL), dt AS (SELECT dw.*, labels FROM dw LEFT JOIN (SELECT vid, i, string_agg(label, ', ' ORDER BY f, label) AS labels FROM da GROUP BY ALL) AS l USING (vid, i)),
ct AS (SELECT vid, dur, label AS tool, count(*)::VARCHAR AS uses FROM tl WHERE kind = 'action' AND label = (SELECT arg_min(label, run_id) FROM tl AS f WHERE f.kind = 'action' AND f.vid = tl.vid) GROUP BY ALL),
sw AS (SELECT vid, dur, t0 AS w0, coalesce(end2, final) AS w1 FROM k WHERE n > 1 AND k - 1 = {items.picked('n - 1', "'summary'", 'vid')}),
su AS (SELECT sw.vid, sw.dur, w0, w1, string_agg(label || ' (' || printf('%.0f', round(greatest(t0, w0), 1)) || '-' || printf('%.0f', round(least(t1, w1), 1)) || ' s)', '; ' ORDER BY run_id) || '.' AS told FROM sw JOIN ph ON ph.vid = sw.vid AND least(t1, w1) - greatest(t0, w0) > 0 GROUP BY ALL),
i AS ({' UNION ALL '.join(PARTS)}), g AS (SELECT *, {GRID} AS grid FROM i),
u AS (SELECT *, 'Frames sampled at t = [' || grid || CASE WHEN request IS NULL THEN '] s; ' || {ts('probe_t_s')} || ' s elapsed so far.' ELSE '] s of a ' || printf('%.0f', dur) || ' s procedure.' END || chr(10) || '<video>' || chr(10) || coalesce(request, 'How many minutes of surgery remain?') AS asked FROM g)
SELECT {columns} FROM u"""


def kinds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Videos, and a timeline of three kinds."""
    videos, phases = items.stored_videos_and_timeline(spark, sf)
    steps, actions = (phases.filter(F.col("run_id") % k == 0).withColumn("kind", F.lit(kind)) for k, kind in ((2, "step"), (3, "action")))
    return videos, phases.union(steps).union(actions)


def shown_target(t: Column) -> Column:
    """A target as text, field by field."""
    number = lambda fmt, c: F.coalesce(F.format_string(fmt, c), F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    pair = lambda s: F.concat(F.lit("["), an.format_ts(s["t0"]), F.lit(", "), an.format_ts(s["t1"]), F.lit("]"))
    window = F.coalesce(F.array_join(F.transform(t["window"], lambda x: F.format_string("%.1f", F.round(x, 1))), "-"), F.lit(""))
    minutes = F.when(t["minutes"].isNull(), "").otherwise(number("%.2f", t["minutes"]))
    return F.concat_ws("|", F.array_join(F.transform(t["spans"], pair), ", "), F.coalesce(F.array_join(t["labels"], ","), F.lit("")), minutes, text(t["text"]), text(t["answer"]), text(t["count"]), window, t["abstain"].cast("string"))


@query(records_sql(THREE, WHOLE))
def item_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of every family as a whole: id, route, frame times, the three messages, target."""
    videos, timeline = kinds(spark, sf)
    x = tasks.build(videos, timeline, list(EDGES), spark.createDataFrame(list(PARENTS), "name string, parent string"))
    said = F.array_join(F.transform("messages", lambda s: F.concat(s["role"], F.lit(":"), s["content"])), "\n")
    return x.select("id", "sub_type", "regime", "probe_t_s", F.md5(tasks.shown_times("frames.t_sec")).alias("frames"), F.md5(said).alias("messages"), F.md5(shown_target(F.col("target"))).alias("target"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), r AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND k = 1 THEN 'In short: ' || text ELSE text END AS text FROM c)
SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn)) AS digest, md5(arg_min(text, turn) FILTER (WHERE role = 'user')) AS question FROM r GROUP BY conv_id""")
def rewritten_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first question of each conversation in other words, the rest as it was."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    said = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    new = an.with_user_question(F.col("m"), F.concat(F.lit("In short: "), an.user_question(F.col("m"))))
    x = c.select("conv_id", said.alias("m")).select("conv_id", new.alias("m"))
    return x.select("conv_id", F.md5(an.plain_chat(F.col("m"))).alias("digest"), F.md5(an.user_question(F.col("m"))).alias("question"))


SAID = ("Faithful.", "one MINOR slip", "unfaithful", "It is unfaithful, not faithful", "no idea")


@query("WITH v AS (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'faithful' WHEN 1 THEN 'minor' ELSE 'unfaithful' END AS v FROM documents) SELECT source, v AS verdict, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share, round(sum(sum(CASE v WHEN 'faithful' THEN 1e0 WHEN 'minor' THEN 0.5e0 ELSE 0e0 END)) OVER (PARTITION BY source) / sum(count(*)) OVER (PARTITION BY source), 6) AS summ_judge FROM v GROUP BY source, v")
def summary_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on summaries by source: shares of each, and their mean score."""
    said = F.get(F.array(*[F.lit(s) for s in SAID]), (F.col("doc_id") % 5).cast("int"))
    x = m.verdict_shares(table(spark, sf, "documents").select("source", said.alias("verdict")), ["source"], tx.SUMMARY_VERDICTS, "unfaithful")
    return x.select("source", "verdict", "n", F.round("share", 6).alias("share"), F.round("judge", 6).alias("summ_judge"))


SHOW = "coalesce(printf('%.4g', {0}), '')"
B = ("overall", "<30min", "30-60min", "60-120min", ">120min")
LINES = items.IOUS + ", p AS (SELECT label, " + ", ".join(f"max(miou) FILTER (WHERE b = '{b}') AS b{i}" for i, b in enumerate(B)) + " FROM c GROUP BY 1) "


@query(LINES + "SELECT 0::BIGINT AS line, '| method | " + " | ".join(B) + " |' AS text UNION ALL SELECT 1, '|" + "---|" * 6 + "' UNION ALL SELECT 1 + row_number() OVER (ORDER BY label), '| ' || label || ' | ' || " + " || ' | ' || ".join(SHOW.format(f"b{i}") for i in range(5)) + " || ' |' FROM p")
def report_table(spark: SparkSession, sf: str) -> DataFrame:
    """A pivot of the report as lines of text; it has one line per method."""
    pivot = report.build_pivots(report.flatten(items.cells(spark, sf)), ["method"])["miou"]
    lines = report.markdown(pivot.orderBy("method")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


@query(SQL + " SELECT label AS method, round(avg(n_frames), 4) AS n_frames, round(avg(n_frames) * 16, 4) AS n_vis_tokens, round(max(n_frames) * 16 + 64, 4) AS ctx_len, round(avg(t1 - t0), 4) AS gpu_s_per_q FROM rs GROUP BY 1 HAVING label <> 'error'")
def efficiency_table(spark: SparkSession, sf: str) -> DataFrame:
    """The report's efficiency pivot: methods that have such figures, and only their overall cells."""
    x = runs(spark, sf).groupBy("label").agg(F.avg("n_frames").alias("n_frames"), (F.avg("n_frames") * 16).alias("n_vis_tokens"), (F.max("n_frames") * 16 + 64).cast("double").alias("ctx_len"), F.avg(F.col("t1") - F.col("t0")).alias("gpu_s_per_q"), F.count(F.lit(1)).cast("double").alias("n"))
    named = ["n_frames", "n_vis_tokens", "ctx_len", "gpu_s_per_q"]
    metrics = F.map_from_arrays(F.array(*[F.lit(c) for c in named]), F.array(*named))
    none = F.map_from_arrays(F.array(F.lit("n")), F.array("n"))
    cells = x.select(F.col("label").alias("method"), F.when(F.col("label") == "error", none).otherwise(metrics).alias("metrics"), F.create_map(F.lit("<30min"), metrics).alias("by_length"), F.create_map().cast("map<string,string>").alias("provenance"))
    out = report.build_pivots(report.flatten(cells), ["method"])["efficiency"]
    return out.select("method", *[F.round(c, 4).alias(c) for c in named])


SETTINGS = {"eval": {"thresholds": [0.3, 0.5], "seed": 7}, "name": "runs"}


@query(items.IOUS + " SELECT label AS method, b AS len_bucket, n AS n_items, '7' AS seed, 'abc123' AS git_sha, left(sha1('eval.seed = 7' || chr(10) || 'eval.thresholds = [0.3, 0.5]' || chr(10) || 'name = ''runs'''), 12) AS cfg_hash FROM c")
def stamped_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Result cells stamped with what they were made with; the order of settings does not matter."""
    stamp = provenance.provenance(7, dict(reversed(SETTINGS.items())), commit="abc123")
    rows = report.flatten(provenance.stamped(items.cells(spark, sf).drop("provenance"), stamp))
    return rows.select("method", "len_bucket", "n_items", "seed", "git_sha", "cfg_hash")


@query(files.ORACLES["source_coco_json"])
def source_coco_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """The files of ``source_coco_json`` beside as many that are cut short, of another shape or empty objects: those give no rows."""
    path = scratch(spark, "coco")
    files.as_json(files.coco_files(spark, sf), path)
    broken = F.get(F.array(F.lit('{"images": [{"id": 1, "video'), F.lit('["a", 2]'), F.lit("{}"), F.lit('{"images": null, "annotations": [{"image_id": 1}]}')), (F.col("k") % 4).cast("int"))
    videos = files.events(spark, sf).select("video").distinct().select("video", F.substring("video", 2, 9).cast("int").alias("k"))
    other = scratch(spark, "coco-broken")
    videos.select("video", broken.alias("value")).repartition("video").write.partitionBy("video").text(other)
    return files.timeline(readers.read_coco_json(spark, [path, other]))


#: ``task_items`` of the items module builds records of phases alone.
ORACLES["task_items"] = records_sql(PHASES, f"{ID}, task, sub_type, {REGIME} AS regime, 3::INT AS n_messages")
