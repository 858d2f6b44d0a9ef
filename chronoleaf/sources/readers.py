"""Readers of annotation files into frame or timeline tables, by name. All files are read by Spark."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoleaf.operators.timeline import collapse_runs, consecutive_runs, lookup

TIMELINE = ["video_id", "kind", "run_id", "label_id", "label", "t0", "t1"]


def stem(path: Column | None = None) -> Column:
    """File name without folder and extensions."""
    return F.regexp_extract(path if path is not None else F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)


def _video(strip: str = "") -> Column:
    """The file's name without ``strip``, or the value of a folder "video=..." as a partitioned write makes it."""
    folder = F.nullif(F.regexp_extract(F.input_file_name(), r"/video=([^/]+)/[^/]*$", 1), F.lit(""))
    name = F.url_decode(F.coalesce(folder, stem()))
    return F.regexp_replace(name, strip, "") if strip else name


def vocab(spark: SparkSession, names: list[str], first: int = 1) -> DataFrame:
    """(id, name) of a list of labels."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, first)], "id int, name string")


def _labelled(runs: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """Unknown names are dropped after runs were collapsed, so their neighbours stay apart."""
    x = lookup(runs, names, "label").filter(F.col("label_id").isNotNull())
    return x.withColumn("kind", F.lit(kind)).select(*TIMELINE)


def read_dense_text(spark: SparkSession, path: str, names: DataFrame, fps: float = 25.0, suffix: str = "-phase") -> DataFrame:
    """Files of "frame<TAB>phase" lines with a header; time is frame / fps."""
    x = spark.read.text(path, recursiveFileLookup=True).select(_video(f"{suffix}$").alias("video_id"), F.split(F.trim("value"), r"\s+").alias("p"))
    x = x.select("video_id", F.get("p", F.lit(0)).try_cast("long").alias("frame"), F.get("p", F.lit(1)).alias("phase")).filter("frame is not null")
    runs = collapse_runs(x, ["video_id"], "frame", "phase")
    runs = runs.withColumn("t0", F.col("t0") / fps).withColumn("t1", F.col("t1") / fps)
    return _labelled(runs, names, "phase")


def read_tolerant_text(spark: SparkSession, path: str, names: DataFrame, fps: float = 1.0, suffix: str = "") -> DataFrame:
    """Two-column files, by tab, comma or space, with or without a header; time is the row's place / fps.

    A line's place is counted within its file, so a file is one row of whole text.
    """
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(_video(suffix).alias("video_id"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    x = x.withColumn("p", F.filter(F.split(F.trim("v"), r"[\t, ]+"), lambda y: y != "")).filter(F.size("p") >= 2)
    x = x.filter(F.get("p", F.lit(0)).try_cast("long").isNotNull())
    ord_ = F.row_number().over(Window.partitionBy("video_id").orderBy("line")) - 1
    runs = collapse_runs(x.select("video_id", ord_.cast("long").alias("row"), F.get("p", F.lit(1)).alias("phase")), ["video_id"], "row", "phase")
    runs = runs.withColumn("t0", F.col("t0") / fps).withColumn("t1", F.col("t1") / fps)
    return _labelled(runs, names, "phase")


TRIPLETS = "num_frames int, categories struct<instrument:map<string,string>,verb:map<string,string>,target:map<string,string>,phase:map<string,string>>, annotations map<string,array<array<double>>>"


def read_triplet_json(spark: SparkSession, path: str, fps: float = 1.0, phases: DataFrame | None = None) -> DataFrame:
    """One JSON file per video: phases from the first instance of a frame, actions as runs of consecutive frames."""
    x = spark.read.schema(TRIPLETS).json(path, multiLine=True).select(_video().alias("video_id"), "categories", F.explode("annotations").alias("f", "instances"))
    x = x.withColumn("frame", F.col("f").try_cast("long")).filter("frame is not null")
    code = lambda v, i: F.get(v, F.lit(i)).cast("int")
    named = lambda m, c: F.coalesce(F.try_element_at(m, c.cast("string")), c.cast("string"))
    first = F.get("instances", F.lit(0))
    ph = code(first, 14)
    frames = x.filter(F.size("instances") > 0).select("video_id", "frame", F.when(ph >= 0, ph).alias("phase"), F.when(ph >= 0, named(F.col("categories.phase"), ph)).alias("name"))
    # a run at the end lasts to the last frame, even if that has no instance; one before frames without a phase does not
    last = x.groupBy("video_id").agg(F.max("frame").alias("last"), F.max(F.when(F.size("instances") > 0, F.col("frame"))).alias("last_full"))
    runs = collapse_runs(frames.withColumn("both", F.when(F.col("phase").isNotNull(), F.struct("phase", "name"))), ["video_id"], "frame", "both")
    runs = runs.join(last, "video_id").withColumn("t1", F.when(F.col("t1") == F.col("last_full") + 1, F.col("last") + 1).otherwise(F.col("t1")))
    runs = runs.select("video_id", F.lit("phase").alias("kind"), "run_id", (F.col("label.phase") + 1).alias("label_id"), F.col("label.name").alias("label"), (F.col("t0") / fps).alias("t0"), (F.col("t1") / fps).alias("t1"))
    if phases is not None:
        runs = lookup(runs.drop("label_id"), phases, "label").select(*TIMELINE)
    each = x.select("video_id", "frame", "categories", F.explode("instances").alias("v")).filter(F.size("v") >= 15)
    each = each.filter((code(F.col("v"), 1) >= 0) & (code(F.col("v"), 7) >= 0) & (code(F.col("v"), 8) >= 0))
    phrase = F.concat_ws(" ", named(F.col("categories.instrument"), code(F.col("v"), 1)), named(F.col("categories.verb"), code(F.col("v"), 7)), named(F.col("categories.target"), code(F.col("v"), 8)))
    acts = consecutive_runs(each.select("video_id", "frame", phrase.alias("phrase")), ["video_id"], "frame", "phrase")
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("label", "f0"))
    acts = acts.select("video_id", F.lit("action").alias("kind"), order.cast("long").alias("run_id"), F.lit(None).cast("int").alias("label_id"), "label", (F.col("f0") / fps).alias("t0"), (F.col("f1") / fps).alias("t1"))
    return runs.unionByName(acts)


COCO = "images array<struct<id:bigint,video_name:string,frame_num:int,width:int,height:int>>, annotations array<struct<image_id:bigint,phases:int,steps:int>>"


def read_coco_json(spark: SparkSession, path: str, fps: float = 1.0) -> DataFrame:
    """Image and annotation lists in many files; the first annotation of a frame that has a phase (step) counts."""
    x = spark.read.schema(COCO).json(path, multiLine=True, recursiveFileLookup=True).withColumn("file", F.input_file_name()).filter("images is not null and annotations is not null")
    images = x.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.col("i.video_name").alias("video_id"), F.col("i.frame_num").alias("frame"))
    notes = x.select("file", F.posexplode("annotations").alias("pos", "a")).select("file", "pos", "a.image_id", "a.phases", "a.steps")
    j = notes.join(images, ["file", "image_id"])
    out = None
    for kind, col in (("phase", "phases"), ("step", "steps")):
        first = j.filter(F.col(col).isNotNull()).groupBy("video_id", "frame").agg(F.min_by(col, F.struct("file", "pos")).alias("code"))
        runs = collapse_runs(first, ["video_id"], "frame", "code")
        part = runs.select("video_id", F.lit(kind).alias("kind"), "run_id", F.col("label").alias("label_id"), F.col("label").cast("string").alias("label"), (F.col("t0") / fps).alias("t0"), (F.col("t1") / fps).alias("t1"))
        out = part if out is None else out.unionByName(part)
    return out


SPANS_MS = "phases array<struct<start:bigint,`end`:bigint,label_name:string,label_id:int>>, steps array<struct<start:bigint,`end`:bigint,label_name:string,label_id:int>>"
CENTERS = {"SBP": "strasbourg", "BBP": "bern"}


def read_interval_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per video with intervals in milliseconds; phase ids shift by one, step ids do not."""
    x = spark.read.schema(SPANS_MS).json(path, multiLine=True).select(_video().alias("video_id"), "phases", "steps")
    out = None
    for kind, col, shift in (("phase", "phases", 1), ("step", "steps", 0)):
        part = x.select("video_id", F.lit(kind).alias("kind"), F.posexplode(col).alias("i", "s"))
        part = part.select("video_id", "kind", (F.col("i") + 1).cast("long").alias("run_id"), (F.col("s.label_id") + shift).alias("label_id"), F.col("s.label_name").alias("label"), (F.col("s.start") / 1000.0).alias("t0"), (F.col("s.end") / 1000.0).alias("t1"))
        out = part if out is None else out.unionByName(part)
    return out


def center_of(video_id: Column) -> Column:
    """Center by the id's prefix; null for an unknown one."""
    out = None
    for prefix, name in CENTERS.items():
        hit = F.upper(video_id).startswith(prefix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def read_language_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines "video t0 t1 ## sentence": video_id, query, t0, t1; lines of another form are skipped."""
    x = spark.read.text(path).select(F.split("value", "##", 2).alias("s")).filter(F.size("s") == 2)
    x = x.select(F.split(F.trim(F.get("s", F.lit(0))), r"\s+").alias("h"), F.rtrim(F.trim(F.get("s", F.lit(1))), F.lit(".")).alias("query")).filter(F.size("h") >= 3)
    a, b = F.get("h", F.lit(1)).try_cast("double"), F.get("h", F.lit(2)).try_cast("double")
    return x.select(F.get("h", F.lit(0)).alias("video_id"), "query", F.least(a, b).alias("t0"), F.greatest(a, b).alias("t1")).filter("t0 is not null and t1 is not null")


GRAPH = "dataset string, phases array<struct<id:int,name:string>>, steps array<struct<id:int,name:string,parent_phase:int>>, hard_precede array<array<int>>, soft_precede array<array<int>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Procedure graphs: (nodes: dataset, kind, id, name, parent_phase; edges: dataset, a, b, hard)."""
    x = spark.read.schema(GRAPH).json(path, multiLine=True)
    phases = x.select("dataset", F.lit("phase").alias("kind"), F.explode("phases").alias("p")).select("dataset", "kind", "p.id", "p.name", F.lit(None).cast("int").alias("parent_phase"))
    steps = x.select("dataset", F.lit("step").alias("kind"), F.explode("steps").alias("p")).select("dataset", "kind", "p.id", "p.name", "p.parent_phase")
    edge = lambda col, hard: x.select("dataset", F.explode(col).alias("e")).select("dataset", F.get("e", F.lit(0)).alias("a"), F.get("e", F.lit(1)).alias("b"), F.lit(hard).alias("hard"))
    return phases.unionByName(steps), edge("hard_precede", True).unionByName(edge("soft_precede", False))


CELL = "backend string, method string, regime string, ckpt string, dataset string, domain string, center string, task string, sub_type string, split string, in_domain boolean, metrics map<string,string>, by_length map<string,map<string,string>>, provenance map<string,string>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result cells, one JSON file each; files that cannot be parsed are left out. file orders them.

    Metrics are numbers, but for ci or bootstrap_ci, a list of two: column ci maps a bucket to it.
    """
    x = spark.read.schema(CELL + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE")
    x = x.withColumn("file", F.input_file_name()).filter("_corrupt_record is null and metrics is not null").drop("_corrupt_record")
    every = F.map_concat(F.create_map(F.lit("overall"), F.col("metrics")), F.coalesce("by_length", F.create_map().cast("map<string,map<string,string>>")))
    pair = lambda m: F.from_json(F.coalesce(F.try_element_at(m, F.lit("ci")), F.try_element_at(m, F.lit("bootstrap_ci"))), "array<double>")
    numbers = lambda m: F.map_filter(F.transform_values(m, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    x = x.withColumn("ci", F.map_filter(F.transform_values(every, lambda _, m: pair(m)), lambda _, p: p.isNotNull()))
    return x.withColumn("metrics", numbers(F.col("metrics"))).withColumn("by_length", F.transform_values("by_length", lambda _, m: numbers(m)))


def read_paraphrases(spark: SparkSession, path: str) -> DataFrame:
    """Paraphrase cache lines with the order in which later entries win: file name, then line."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    x = x.select("file", "line", F.from_json("v", "key string, orig string, paraphrase string, model string, seed int").alias("r")).filter("r.key is not null")
    return x.select("r.*", F.struct("file", "line").alias("order"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, json) of the .json members of tar files; a file is streamed by one task."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    found = [(p, m.name[:-5], tar.extractfile(m).read().decode()) for m in tar if m.isfile() and m.name.endswith(".json") and m.name != "manifest.json"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 3, names=["shard", "key", "json"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path", "content").mapInArrow(members, "shard string, key string, json string")


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def frame_index(spark: SparkSession, path: str, fps: float = 1.0, meta: DataFrame | None = None, pattern: str = "*.jpg") -> DataFrame:
    """Nine columns per frame file under <root>/<video>/: sizes come from ``meta`` (video_id, width, height, center, domain, split).

    Only file names are read. The frame number is the trailing run of digits of the name, 0 without any.
    """
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    return index_of_paths(x, fps, meta)


def index_of_paths(paths: DataFrame, fps: float = 1.0, meta: DataFrame | None = None) -> DataFrame:
    """``frame_index`` of a table of paths."""
    name = stem(F.col("path"))
    x = paths.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("frame_idx"), "path")
    x = x.withColumn("t_sec", F.round(F.col("frame_idx") / F.lit(fps), 3))
    if meta is not None:
        x = x.join(meta, "video_id", "left")
    has = lambda c, kind: (F.col(c) if c in x.columns else F.lit(None)).cast(kind)
    text = lambda c: F.coalesce(has(c, "string"), F.lit("")).alias(c)
    return x.select("video_id", "frame_idx", "t_sec", "path", has("width", "int").alias("width"), has("height", "int").alias("height"), text("center"), text("domain"), text("split"))


def frames_in_window(index: DataFrame, t0: float, t1: float) -> DataFrame:
    """Frames whose number lies in the window, both ends included."""
    return index.filter(F.col("frame_idx").between(t0, t1))


def synthetic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Six fixed videos (18 to 152 minutes) with five phases, ten steps and six actions each: (videos, timeline).

    Phase lengths are shares drawn by hash around equal parts, so the table is the same everywhere.
    """
    rows = [("sv_short_0", 1080.0, "train"), ("sv_short_1", 1980.0, "val"), ("sv_mid_0", 3300.0, "train"), ("sv_mid_1", 5400.0, "test"), ("sv_long_0", 7680.0, "val"), ("sv_long_1", 9120.0, "test")]
    videos = spark.createDataFrame([("synthetic", v, d, "simulated", None, s) for v, d, s in rows], "dataset string, video_id string, duration_s double, domain string, center string, split string")
    share = lambda p: 0.8 + 0.4 * F.pmod(F.xxhash64("video_id", p), F.lit(1000)) / 999.0
    w = videos.select("dataset", "video_id", "duration_s", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p")).withColumn("w", share(F.col("p")))
    run = Window.partitionBy("video_id").orderBy("p")
    total = F.sum("w").over(Window.partitionBy("video_id"))
    edge = F.sum("w").over(run) / total * F.col("duration_s")
    p = w.withColumn("t1", F.round(edge, 1)).withColumn("t0", F.coalesce(F.lag("t1").over(run), F.lit(0.0)))
    phases = p.select("dataset", "video_id", F.lit("phase").alias("kind"), F.col("p").cast("long").alias("run_id"), F.col("p").alias("label_id"), F.concat(F.lit("phase "), F.col("p")).alias("label"), "t0", "t1")
    half = p.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    mid = (F.col("t0") + F.col("t1")) / 2
    sid = (F.col("p") - 1) * 2 + F.col("h") + 1
    steps = half.select("dataset", "video_id", F.lit("step").alias("kind"), sid.cast("long").alias("run_id"), sid.alias("label_id"), F.concat(F.lit("step "), sid).alias("label"), F.when(F.col("h") == 0, F.col("t0")).otherwise(mid).alias("t0"), F.when(F.col("h") == 0, mid).otherwise(F.col("t1")).alias("t1"))
    a = videos.select("dataset", "video_id", "duration_s", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    at = F.round(F.pmod(F.xxhash64("video_id", F.lit("action"), "k"), F.lit(10_000)) / 10_000.0 * (F.col("duration_s") - 60), 1)
    tool = F.get(F.array(*[F.lit(x) for x in ("grasper hold tissue", "hook cut tissue", "clipper clip vessel")]), F.pmod(F.xxhash64("video_id", "k"), F.lit(3)).cast("int"))
    acts = a.select("dataset", "video_id", F.lit("action").alias("kind"), F.col("k").cast("long").alias("run_id"), F.lit(None).cast("int").alias("label_id"), tool.alias("label"), at.alias("t0"), (at + 5.0 * F.col("k")).alias("t1"))
    return videos, phases.unionByName(steps).unionByName(acts)


def read_synthetic(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The timeline of ``synthetic``, which needs no files."""
    return synthetic(spark)[1].select(*TIMELINE)


#: name -> reader(spark, path, ...)
READERS: dict[str, Callable[..., DataFrame]] = {
    "dense_text": read_dense_text,
    "tolerant_text": read_tolerant_text,
    "triplet_json": read_triplet_json,
    "coco_json": read_coco_json,
    "interval_json": read_interval_json,
    "language_queries": read_language_queries,
    "synthetic": read_synthetic,
}


def reader(name: str) -> Callable[..., DataFrame]:
    if name not in READERS:
        raise KeyError(f"unknown source {name!r}; known: {sorted(READERS)}")
    return READERS[name]


