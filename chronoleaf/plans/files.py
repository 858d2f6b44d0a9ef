"""Driver queries on sources and sinks: each writes whole driver tables in a form of files and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.operators import report
from chronoleaf.operators import selection as sel
from chronoleaf.plans import items
from chronoleaf.plans.base import LABELS, scratch, table
from chronoleaf.sources import datasets, readers, sinks, tar_source

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Users stand in for videos by a remainder, events for frames, their types for labels; one label is not in the vocabulary.
VIDEO, UNKNOWN = "'v' || (user_id % 16)", "signup"
KNOWN = [x for x in LABELS if x != UNKNOWN]
EVENTS = f"WITH e AS (SELECT {VIDEO} AS video_id, event_id, event_type AS label FROM events)"
ID_OF = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(KNOWN, 1)) + " END"


def runs_sql(frames: str, label: str = "label", last: str = "max(k) + 1", keep: str = "") -> str:
    """CTEs f (video_id, k, label) -> r (video_id, run_id, label, t0, t1)."""
    return f""", f AS ({frames}), c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR {label} IS DISTINCT FROM lag({label}) OVER w THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY video_id ORDER BY k)),
g AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM c), b AS (SELECT video_id, run_id, any_value({label}) AS label, min(k) AS t0, {last} AS l FROM g GROUP BY ALL),
r AS (SELECT video_id, run_id, label, t0, coalesce(lead(t0) OVER (PARTITION BY video_id ORDER BY run_id), l) AS t1 FROM b){keep}"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("v"), F.col("user_id") % 16).alias("video"), "event_id", F.col("event_type").alias("label"), "value", "user_id")


def known(spark: SparkSession) -> DataFrame:
    return readers.vocab(spark, KNOWN)


def many(spark: SparkSession) -> int:
    """A number of tasks that stays: files cost far more than their bytes, by which small partitions would be merged into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def as_text(lines: DataFrame, path: str, *order: str) -> str:
    """One file per video of (video, value), in the order of further columns."""
    x = lines.repartition(many(lines.sparkSession), "video").sortWithinPartitions("video", *order)
    x.select("video", "value").write.partitionBy("video").text(path)
    return path


def as_json(rows: DataFrame, path: str) -> str:
    """One JSON file per row, in a folder of its video."""
    rows.repartition(many(rows.sparkSession), "video").write.partitionBy("video").json(path)
    return path


def timeline(x: DataFrame) -> DataFrame:
    return x.select("video_id", "kind", "run_id", "label_id", "label", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


OUT = "SELECT video_id, {kind} AS kind, run_id, {ids}::INT AS label_id, label, round(t0 / {fps}, 6) AS t0, round(t1 / {fps}, 6) AS t1 FROM r WHERE label IS NOT NULL AND {where} "


@query(EVENTS + runs_sql("SELECT video_id, event_id AS k, label FROM e") + OUT.format(kind="'phase'", ids=ID_OF, fps="25e0", where=f"label <> '{UNKNOWN}'"))
def source_dense_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines "frame<TAB>phase" after a header, at 25 frames a second."""
    x = events(spark, sf)
    lines = x.select("video", "event_id", F.concat_ws("\t", F.col("event_id").cast("string"), F.initcap("label")).alias("value"))
    head = x.select("video").distinct().select("video", F.lit(-1).cast("long").alias("event_id"), F.lit("Frame\tPhase").alias("value"))
    path = as_text(lines.union(head), scratch(spark, "dense"), "event_id")
    out = readers.reader("dense_text")(spark, path, known(spark))
    return timeline(out.withColumn("label", F.lower("label")))


@query(EVENTS + runs_sql("SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) - 1 AS k, label FROM e") + OUT.format(kind="'phase'", ids=ID_OF, fps="1e0", where=f"label <> '{UNKNOWN}'"))
def source_tolerant_text(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns with mixed separators, a header and lines of one column; time is a row's place."""
    x = events(spark, sf)
    sep = F.get(F.array(F.lit("\t"), F.lit(", "), F.lit(" ")), (F.col("event_id") % 3).cast("int"))
    lines = x.select("video", "event_id", F.concat(F.col("event_id").cast("string"), sep, F.col("label"), F.when(F.col("event_id") % 10 == 0, "\nalone").otherwise("")).alias("value"))
    head = x.select("video").distinct().select("video", F.lit(-1).cast("long").alias("event_id"), F.lit("frame phase").alias("value"))
    path = as_text(lines.union(head), scratch(spark, "tolerant"), "event_id")
    return timeline(readers.reader("tolerant_text")(spark, path, known(spark)))


PHASE = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE {0} END"
CODE = "CASE event_type " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS)) + " END"
ACTS = "a AS (SELECT DISTINCT video_id, k, phrase FROM (SELECT 'v' || (user_id % 16) AS video_id, event_id // 4 AS k, 'tool' || (event_id % 2) || ' cut ' || (event_id % 3) AS phrase FROM events WHERE event_id % 7 <> 0)), i AS (SELECT *, k - row_number() OVER (PARTITION BY video_id, phrase ORDER BY k) AS isle FROM a), n AS (SELECT video_id, phrase, min(k) AS f0, max(k) + 1 AS f1 FROM i GROUP BY video_id, phrase, isle HAVING count(*) >= 2)"


@query("WITH p AS (SELECT 'v' || (user_id % 16) AS video_id, event_id // 4 AS k, min(event_id) AS e FROM events GROUP BY ALL), q AS (SELECT p.video_id, k, " + PHASE.format("event_type") + " AS label FROM p JOIN events ON event_id = e)" + runs_sql("SELECT video_id, k, label FROM q") + ", " + ACTS + " SELECT video_id, 'phase' AS kind, run_id, CASE label " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(LABELS)) + " END::INT AS label_id, label, t0::DOUBLE AS t0, t1::DOUBLE AS t1 FROM r WHERE label IS NOT NULL UNION ALL SELECT video_id, 'action', row_number() OVER (PARTITION BY video_id ORDER BY phrase, f0), NULL, phrase, f0, f1 FROM n")
def source_triplet_json(spark: SparkSession, sf: str) -> DataFrame:
    """Four events make a frame: the first one's type is its phase (-1 for each eleventh), each one is an instance."""
    x = table(spark, sf, "events").select(F.concat(F.lit("v"), F.col("user_id") % 16).alias("video"), "event_id", F.floor(F.col("event_id") / 4).alias("frame"), "event_type")
    code = F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.array_position(F.array(*[F.lit(y) for y in LABELS]), F.col("event_type")) - 1)
    of = {1: F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("event_id") % 2), 7: F.lit(0), 8: F.col("event_id") % 3, 14: code}
    vector = F.array(*[of.get(k, F.lit(0)).cast("double") for k in range(15)])
    frames = x.groupBy("video", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", vector.alias("v")))), lambda s: s["v"]).alias("v"))
    named = lambda *names: F.create_map(*[F.lit(y) for i, n in enumerate(names) for y in (str(i), n)])
    names = F.struct(named("tool0", "tool1").alias("instrument"), named("cut").alias("verb"), named().cast("map<string,string>").alias("target"), named(*LABELS).alias("phase"))
    notes = F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), "v")))
    rows = frames.groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("num_frames"), notes.alias("annotations")).withColumn("categories", names)
    return timeline(readers.reader("triplet_json")(spark, as_json(rows, scratch(spark, "triplet"))))


COCO_RUNS = runs_sql("SELECT video_id, frame AS k, arg_min(code, event_id) AS label FROM n WHERE code IS NOT NULL GROUP BY ALL")


@query("WITH n AS (SELECT 'v' || (user_id % 16) AS video_id, event_id // 2 AS frame, event_id, CASE WHEN event_id % 5 <> 0 THEN (event_id // 30) % 4 END AS code FROM events)" + COCO_RUNS + " SELECT video_id, 'phase' AS kind, run_id, label::INT AS label_id, label::VARCHAR AS label, t0::DOUBLE AS t0, t1::DOUBLE AS t1 FROM r")
def source_coco_json(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of images and of annotations in a file per video: two events are a frame, one in five has no phase."""
    return timeline(readers.reader("coco_json")(spark, as_json(coco_files(spark, sf), scratch(spark, "coco"))))


def coco_files(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("video", "event_id", F.floor(F.col("event_id") / 2).alias("frame"), F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 30) % 4).cast("int").alias("phases"))
    image = F.struct(F.col("frame").alias("id"), F.col("video").alias("video_name"), F.col("frame").cast("int").alias("frame_num"), F.lit(4).alias("width"), F.lit(3).alias("height"))
    note = F.struct("event_id", F.struct(F.col("frame").alias("image_id"), "phases", F.lit(None).cast("int").alias("steps")).alias("a"))
    rows = e.groupBy("video").agg(F.collect_set(image).alias("images"), F.transform(F.array_sort(F.collect_list(note)), lambda n: n["a"]).alias("annotations"))
    return rows


@query("WITH o AS (SELECT 'SBP' || (o_custkey % 10) AS video_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS run_id, o_orderpriority AS label, (o_orderkey % 5)::INT AS code FROM orders) SELECT video_id, 'phase' AS kind, run_id, code + 1 AS label_id, label, round(o_orderkey * 250 / 1e3, 6) AS t0, round((o_orderkey * 250 + 700) / 1e3, 6) AS t1 FROM o UNION ALL SELECT video_id, 'step', run_id, code, label, round(o_orderkey * 250 / 1e3, 6), round((o_orderkey * 250 + 100) / 1e3, 6) FROM o")
def source_interval_json(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals in milliseconds, a file per video."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("SBP"), F.col("o_custkey") % 10).alias("video"), "o_orderkey", "o_orderpriority")
    at = F.col("o_orderkey") * 250
    interval = lambda n: F.struct(at.alias("start"), (at + n).alias("end"), F.col("o_orderpriority").alias("label_name"), (F.col("o_orderkey") % 5).cast("int").alias("label_id"))
    both = F.array_sort(F.collect_list(F.struct("o_orderkey", interval(700).alias("p"), interval(100).alias("s"))))
    rows = o.groupBy("video").agg(both.alias("b")).select("video", F.col("b.p").alias("phases"), F.col("b.s").alias("steps"))
    return timeline(readers.reader("interval_json")(spark, as_json(rows, scratch(spark, "interval"))))


@query("SELECT 'v' || l_suppkey AS video_id, 'line ' || l_orderkey || ' of ' || l_linenumber AS query, round(least(l_quantity, l_extendedprice), 6) AS t0, round(greatest(l_quantity, l_extendedprice), 6) AS t1 FROM lineitem")
def source_language_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Lines "video t1 t0 ## sentence." among lines of another form, which are skipped."""
    x = table(spark, sf, "lineitem")
    sentence = F.concat(F.lit("line "), F.col("l_orderkey"), F.lit(" of "), F.col("l_linenumber"), F.lit("."))
    line = F.concat(F.lit("v"), F.col("l_suppkey"), F.lit(" "), F.col("l_extendedprice"), F.lit(" "), F.col("l_quantity"), F.lit(" ## "), sentence)
    path = scratch(spark, "queries")
    x.select(F.when(F.col("l_linenumber") == 1, F.concat(line, F.lit("\nno spans ## here\nv1 2 3"))).otherwise(line).alias("value")).write.text(path)
    return readers.reader("language_queries")(spark, path).select("video_id", "query", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query("SELECT 'trade' AS dataset, 'phase' AS kind, r_regionkey::INT AS id, r_name AS name, NULL::INT AS parent_phase, NULL::INT AS b, NULL::BOOLEAN AS hard FROM region UNION ALL SELECT 'trade', 'step', n_nationkey::INT, n_name, n_regionkey::INT, NULL, NULL FROM nation UNION ALL SELECT 'trade', 'edge', n_nationkey::INT, NULL, NULL, n_nationkey::INT + 1, n_nationkey % 2 = 0 FROM nation")
def source_graph_json(spark: SparkSession, sf: str) -> DataFrame:
    """A procedure graph as one JSON object: regions are phases, nations are steps and hold the edges."""
    every = lambda df, col: df.agg(F.collect_list(col).alias("c"))
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("int")
    edge = lambda odd: F.filter(F.collect_list(F.array(key, key + 1)), lambda e: e[0] % 2 == odd)
    graph = n.agg(F.collect_list(F.struct(key.alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("parent_phase"))).alias("steps"), edge(0).alias("hard_precede"), edge(1).alias("soft_precede"))
    phases = every(r, F.struct(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"))).select(F.col("c").alias("phases"))
    path = scratch(spark, "graph")
    graph.join(F.broadcast(phases)).withColumn("dataset", F.lit("trade")).coalesce(1).write.json(path)
    nodes, edges = readers.read_graph(spark, path)
    null = lambda kind: F.lit(None).cast(kind)
    nodes = nodes.select("dataset", "kind", "id", "name", "parent_phase", null("int").alias("b"), null("boolean").alias("hard"))
    return nodes.union(edges.select("dataset", F.lit("edge"), "a", null("string"), null("int"), "b", "hard"))


@query(items.ORACLES["metric_flatten"])
def source_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result cells as JSON files and back to rows."""
    path = scratch(spark, "results")
    as_json(items.cells(spark, sf).withColumn("video", F.col("method")), path)
    return report.flatten(readers.read_results(spark, path)).select("method", "len_bucket", "miou", "n_items", "seed")


@query("SELECT doc_id, CASE WHEN item_id IS NULL THEN 'question ' || doc_id WHEN item_id % 7 = 0 THEN 'question ' || doc_id ELSE md5(b.text) END AS q FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def source_paraphrases(spark: SparkSession, sf: str) -> DataFrame:
    """A paraphrase cache of whole benchmark texts; a later line of a key wins, a blank one keeps the question."""
    b = table(spark, sf, "benchmark").withColumn("key", an.cache_key(F.lit("t5"), F.col("item_id").cast("string")))
    first = b.select("key", F.lit("outdated").alias("paraphrase"), F.lit(0).alias("o"), "item_id")
    later = b.select("key", F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.col("text")).alias("paraphrase"), F.lit(1).alias("o"), "item_id")
    lines = first.union(later).select(F.lit("all").alias("video"), F.to_json(F.struct("key", F.lit("q").alias("orig"), "paraphrase", F.lit("m").alias("model"), F.lit(0).alias("seed"))).alias("value"), "o", "item_id")
    cache = readers.read_paraphrases(spark, as_text(lines, scratch(spark, "paraphrases"), "o", "item_id"))
    d = table(spark, sf, "documents").select("doc_id", an.cache_key(F.lit("t5"), F.col("doc_id").cast("string")).alias("key"), F.concat(F.lit("question "), F.col("doc_id")).alias("q"))
    out = sel.paraphrased(d, cache, "key", "q", "order")
    return out.select("doc_id", F.when(F.col("q").startswith("question "), F.col("q")).otherwise(F.md5("q")).alias("q"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def sink_tar_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as JSON members of tar files with a manifest, and back from the files."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "role", "text")
    path = scratch(spark, "shards")
    listed = sinks.write_shards(sinks.pack_shards(c, "id", 0.2), path)
    x = readers.read_shards(spark, path).withColumn("shard", readers.stem(F.col("shard")))
    x = x.join(listed.select("shard"), "shard", "left_semi").select(F.from_json("json", "conv_id long, turn int, role string, text string").alias("r"))
    return x.select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("digest"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def source_json_tar(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations through the tar data source, whose reader splits shards by their indexes."""
    tar_source.register(spark)
    c = table(spark, sf, "conversations")
    path = scratch(spark, "json-tar")
    x = c.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("json"))
    x.write.format("json_tar").option("shard_mb", "0.5").option("split_bytes", str(1 << 17)).mode("append").save(path)
    y = spark.read.format("json_tar").load(path).select(F.from_json("json", "conv_id long, turn int, role string, text string").alias("r"))
    return y.select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("digest"))


@query("SELECT shard_items AS n_items, members FROM (SELECT count(*) AS shard_items, count(*) AS members FROM conversations)")
def sink_shard_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Members that the manifest counts, and those that the files hold."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    path = scratch(spark, "shards")
    n = sinks.write_shards(sinks.pack_shards(c, "id", 0.2), path).select("n", F.lit(0).alias("m"))
    return n.unionAll(readers.read_shards(spark, path).select(F.lit(0), F.lit(1))).agg(F.sum("n").alias("n_items"), F.sum("m").alias("members"))


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def sink_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Item lines with explicit nulls, and back."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    path = scratch(spark, "items")
    sinks.write_jsonl(o, path)
    return readers.read_items(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


@query(items.IOUS + " SELECT label AS method, b AS len_bucket, miou, n AS n_items, '0' AS seed, 52::BIGINT AS n_columns FROM c")
def sink_long_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The long result table as CSV with its fixed columns, empty where missing, and back."""
    path = scratch(spark, "csv")
    sinks.write_long_csv(report.flatten(items.cells(spark, sf)), path)
    x = spark.read.csv(path, header=True)
    return x.select("method", "len_bucket", F.col("miou").cast("double").alias("miou"), F.col("n_items").cast("double").alias("n_items"), "seed", F.lit(len(x.columns)).cast("long").alias("n_columns"))


INDEX = "SELECT 'v' || (user_id % 16) AS video_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE event_id END::INT AS frame_idx, CASE WHEN user_id % 16 < 8 THEN 'north' ELSE '' END AS center, CASE WHEN user_id % 16 < 8 THEN 64 END::INT AS width FROM events"


@query(f"WITH i AS ({INDEX}) SELECT video_id, frame_idx, round(frame_idx / 2e0, 3) AS t_sec, center, width FROM i WHERE frame_idx BETWEEN 100 AND 7000")
def sink_frame_index(spark: SparkSession, sf: str) -> DataFrame:
    """Frame files by name to an index partitioned by video, and the frames of a window from it."""
    e = events(spark, sf)
    name = F.when(F.col("event_id") % 50 == 0, "cover").otherwise(F.format_string("img_%06d", "event_id"))
    paths = e.select(F.concat(F.lit("s3://frames/"), F.col("video"), F.lit("/"), name, F.lit(".jpg")).alias("path"))
    meta = spark.createDataFrame([(f"v{k}", 64, 48, "north") for k in range(8)], "video_id string, width int, height int, center string")
    path = scratch(spark, "index")
    sinks.write_frame_index(readers.index_of_paths(paths, 2.0, meta), path)
    x = readers.frames_in_window(spark.read.parquet(path), 100, 7000)
    return x.select("video_id", "frame_idx", "t_sec", "center", "width")


NAMED = "WITH v AS (SELECT r_name AS dataset, 'phase' AS kind, n_name AS name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 + r_regionkey AS id FROM region JOIN nation ON n_regionkey = r_regionkey), w AS (SELECT * FROM v UNION ALL SELECT 'stand-in', kind, name, id FROM v WHERE dataset = 'ASIA')"


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as datasets, their nations as phases, and one that stands in for another."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    names = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    split = F.struct(F.when(F.col("r_regionkey") % 2 == 0, "by_video").otherwise("all_test").alias("scheme"), F.array(F.lit(2), F.lit(1), F.lit(1)).alias("counts"))
    x = r.join(names, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("dataset"), F.col("r_regionkey").cast("int").alias("first_id"), F.create_map(F.lit("phase"), "names").alias("labels"), split.alias("split"), F.lit(None).cast("string").alias("alias_of"))
    alias = r.filter("r_name = 'ASIA'").select(F.lit("stand-in").alias("dataset"), F.col("r_name").alias("alias_of"))
    path = scratch(spark, "datasets")
    x.unionByName(alias, allowMissingColumns=True).write.json(path)
    return datasets.read_datasets(spark, path)


@query(NAMED + " SELECT dataset, kind, id::INT AS id, name FROM w")
def source_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabularies of dataset descriptions, one of which stands in for another."""
    return datasets.vocabulary(described(spark, sf))


@query(NAMED + " SELECT x.dataset, x.name AS a, y.name AS b FROM w x JOIN w y ON x.dataset = y.dataset AND y.id = x.id + 1")
def dataset_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Precedence from the order of a vocabulary."""
    return datasets.chain_edges(described(spark, sf))


@query("WITH k AS (SELECT s_name, row_number() OVER (ORDER BY md5('0:' || s_name), s_name) AS k, count(*) OVER () AS n FROM supplier) SELECT s_name, CASE WHEN k <= round_even(n * 0.5e0, 0) THEN 'train' WHEN k <= round_even(n * 0.5e0, 0) + round_even(n * 0.25e0, 0) THEN 'val' ELSE 'test' END AS split FROM k")
def dataset_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split that a dataset's description asks for."""
    return datasets.split_videos(table(spark, sf, "supplier").select("s_name"), described(spark, sf), "ASIA", "s_name")
