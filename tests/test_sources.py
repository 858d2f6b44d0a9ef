"""Readers and sinks on small literal files; runs, graphs and reports on literal tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from chronoleaf.operators import graph, metrics, provenance, report, selection, tasks
from chronoleaf.operators import timeline as tl
from chronoleaf.sources import readers, sinks
from chronoleaf.streaming import live

PHASES = ["Preparation", "CalotTriangleDissection", "ClippingAndCutting"]


def spans(df, kind="phase"):
    rows = df.filter(F.col("kind") == kind).orderBy("video_id", "t0").collect()
    return [(r.label_id, r.t0, r.t1) for r in rows]


def test_dense_text(spark, tmp_path):
    lines = ["Frame\tPhase", *[f"{i}\t{PHASES[0] if i < 25 else PHASES[1]}" for i in range(75)]]
    (tmp_path / "video01-phase.txt").write_text("\n".join(lines) + "\n")
    x = readers.read_dense_text(spark, str(tmp_path), readers.vocab(spark, PHASES))
    assert spans(x) == [(1, 0.0, 1.0), (2, 1.0, 3.0)]
    assert tl.durations(x, ["video_id"]).collect()[0].duration_s == 3.0
    assert x.first().video_id == "video01"


def test_unknown_labels_do_not_merge_neighbours(spark, tmp_path):
    (tmp_path / "v-phase.txt").write_text("Frame Phase\n0 Preparation\n25 Nothing\n50 Preparation\n")
    x = readers.read_dense_text(spark, str(tmp_path), readers.vocab(spark, PHASES))
    assert spans(x) == [(1, 0.0, 1.0), (1, 2.0, 2.04)]


def test_tolerant_text(spark, tmp_path):
    (tmp_path / "01.txt").write_text("Frame\tPhase\n0\tPreparation\n1\tPreparation\n2\tPreparation\n" + "".join(f"{i}\tCalotTriangleDissection\n" for i in range(3, 8)))
    (tmp_path / "02.txt").write_text("0,preparation\n1,preparation\n")
    x = readers.read_tolerant_text(spark, str(tmp_path), readers.vocab(spark, PHASES)).cache()
    assert spans(x.filter("video_id = '01'")) == [(1, 0.0, 3.0), (2, 3.0, 8.0)]
    assert spans(x.filter("video_id = '02'")) == [(1, 0.0, 2.0)]


def test_triplet_json(spark, tmp_path):
    vec = lambda a, p: [0, a, 0, 0, 0, 0, 0, a, a, 0, 0, 0, 0, 0, p]
    doc = {"num_frames": 4, "categories": {"instrument": {"0": "grasper"}, "verb": {"0": "dissect"}, "target": {"0": "gallbladder"}, "phase": {"0": "preparation", "1": "carlot"}}, "annotations": {"0": [vec(0, 0)], "1": [vec(0, 0)], "2": [vec(0, 1)], "3": [vec(-1, 1)]}}
    (tmp_path / "VID01.json").write_text(json.dumps(doc))
    x = readers.read_triplet_json(spark, str(tmp_path)).cache()
    assert spans(x) == [(1, 0.0, 2.0), (2, 2.0, 4.0)]
    assert [(r.label, r.t0, r.t1) for r in x.filter("kind = 'action'").collect()] == [("grasper dissect gallbladder", 0.0, 3.0)]


def test_coco_json(spark, tmp_path):
    doc = {"images": [{"id": i, "video_name": "c1", "frame_num": i, "width": 4, "height": 3} for i in range(3)], "annotations": [{"image_id": 0, "phases": 0, "steps": 1}, {"image_id": 1, "phases": 0, "steps": 1}, {"image_id": 1, "phases": 1, "steps": 2}, {"image_id": 2, "phases": 1, "steps": 2}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text('{"other": 1}')
    x = readers.read_coco_json(spark, str(tmp_path)).cache()
    assert spans(x) == [(0, 0.0, 2.0), (1, 2.0, 3.0)] and spans(x, "step") == [(1, 0.0, 2.0), (2, 2.0, 3.0)]


def test_interval_json(spark, tmp_path):
    row = lambda a, b, i: {"start": a, "end": b, "label_name": f"n{i}", "label_id": i}
    (tmp_path / "SBP01.json").write_text(json.dumps({"phases": [row(0, 2000, 0), row(2000, 5000, 1)], "steps": [row(0, 1000, 1), row(1000, 2000, 2)]}))
    x = readers.read_interval_json(spark, str(tmp_path)).cache()
    assert spans(x) == [(1, 0.0, 2.0), (2, 2.0, 5.0)] and spans(x, "step") == [(1, 0.0, 1.0), (2, 1.0, 2.0)]
    assert x.select(readers.center_of(F.col("video_id"))).first()[0] == "strasbourg"


def test_language_queries(spark, tmp_path):
    (tmp_path / "q.txt").write_text("AB 9.0 2.5 ## a person opens a door.\nbad line\nX 1 ## y\n")
    assert [tuple(r) for r in readers.read_language_queries(spark, str(tmp_path)).collect()] == [("AB", "a person opens a door", 2.5, 9.0)]


def test_results_and_report(spark, tmp_path):
    cell = lambda name, v: {"method": name, "task": "t1", "metrics": {"r1@0.5": v, "n": 4, "odd": 1}, "by_length": {"<30min": {"r1@0.5": 0.6}, "60-120min": {"r1@0.5": 0.75}}, "provenance": {"seed": "1"}}
    (tmp_path / "a.json").write_text(json.dumps(cell("sft", 0.7)))
    (tmp_path / "b.json").write_text(json.dumps(cell("zero", 0.2)))
    (tmp_path / "c.json").write_text("{broken")
    cells = readers.read_results(spark, str(tmp_path)).cache()
    rows = report.flatten(cells)
    assert rows.columns == report.RESULT_COLUMNS and rows.count() == 6
    assert rows.filter("len_bucket = 'overall' and method = 'sft'").select("`r1@0.5`", "n_items").first()[:] == (0.7, 4.0)
    text = report.markdown(report.pivot_by_length(rows, "r1@0.5", ["method"]).orderBy("method"))
    assert "0.6" in text and "0.75" in text and text.splitlines()[2].startswith("| sft | 0.7 ")
    assert report.long_metrics(cells).filter("metric = 'odd'").count() == 2
    assert set(report.build_pivots(rows, ["method"])) == {"r1@0.5", "miou", "frame_acc", "efficiency"}
    sinks.write_long_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == report.RESULT_COLUMNS


def test_graph_files(spark, tmp_path):
    doc = {"dataset": "d", "phases": [{"id": i, "name": n} for i, n in enumerate(PHASES, 1)], "steps": [{"id": 1, "name": "s", "parent_phase": 2}, {"id": 2, "name": "t"}], "hard_precede": [[1, 2], [2, 3]], "soft_precede": [[1, 3]]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = readers.read_graph(spark, str(tmp_path))
    reach = graph.closure(edges.filter("hard").select("a", "b"))
    assert {tuple(r) for r in reach.collect()} == {(1, 2), (2, 3), (1, 3)}
    bad = spark.createDataFrame([("v", 1, 3, 0.0), ("v", 2, 1, 5.0)], "video_id string, run_id int, label int, t0 double")
    assert [(r.first, r.second) for r in graph.violations(bad, reach, ["video_id"]).collect()] == [(3, 1)]
    assert graph.violation_counts(bad, reach, ["video_id"]).first().n_violations == 1
    assert {r.label for r in graph.forbidden_next(bad.filter("label = 3"), reach, ["video_id"]).collect()} == {1, 2}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "step int, phase int")
    assert {(r.step, r.phase, r.consistent) for r in graph.step_phase_consistent(pairs, nodes.filter("kind = 'step'")).collect()} == {(1, 2, True), (1, 3, False), (2, 3, True)}
    cyc = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert graph.closure(cyc).count() == 4


def test_shards(spark, tmp_path):
    items = spark.range(200).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), F.lit(50)).alias("text")).coalesce(1)
    assert sinks.pack_shards(items, "id", 2000).count() == 1
    small = sinks.pack_shards(items, "id", 0.02).cache()
    assert small.count() > 1 and sinks.unpack_shards(small).select("key").distinct().count() == 200
    for r in small.collect():
        (tmp_path / f"{r.shard}.tar").write_bytes(r.content)
    assert readers.read_shards(spark, str(tmp_path)).count() == 200
    assert sinks.manifest(small).agg(F.sum("n")).first()[0] == 200


def test_frame_index(spark, tmp_path):
    for v in ("v1", "v2"):
        (tmp_path / v).mkdir()
        for i in (0, 7):
            (tmp_path / v / f"frame_{i:05d}.jpg").write_bytes(b"x")
    meta = spark.createDataFrame([("v1", 4, 3, "c", "d", "train")], "video_id string, width int, height int, center string, domain string, split string")
    x = readers.frame_index(spark, str(tmp_path), 2.0, meta).cache()
    got = {(r.video_id, r.frame_idx): (r.t_sec, r.width, r.center) for r in x.collect()}
    assert got[("v1", 7)] == (3.5, 4, "c") and got[("v2", 0)] == (0.0, None, "")
    assert readers.frames_in_window(x, 0, 6).count() == 2


def test_paraphrases(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "k", "paraphrase": "old"}\nnot json\n{"key": "b", "paraphrase": " "}\n')
    (tmp_path / "b.jsonl").write_text('{"key": "k", "paraphrase": "new"}\n')
    cache = readers.read_paraphrases(spark, str(tmp_path))
    items = spark.createDataFrame([("k", "q1"), ("b", "q2"), ("z", "q3")], "key string, q string")
    assert {r.key: r.q for r in selection.paraphrased(items, cache, "key", "q", "order").collect()} == {"k": "new", "b": "q2", "z": "q3"}


def test_rasterize_later_run_wins(spark):
    runs = spark.createDataFrame([("v", 1, "A", 0.0, 3.0), ("v", 2, "B", 2.0, 5.0)], "video_id string, run_id int, label string, t0 double, t1 double")
    dur = spark.createDataFrame([("v", 6.0)], "video_id string, duration_s double")
    x = tl.rasterize(runs, ["video_id"], dur, 1.0, "-").orderBy("sec")
    assert [r.label for r in x.collect()] == ["A", "A", "B", "B", "B", "-"]


def test_calibration(spark):
    x = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate([(0.9, 1), (0.8, 1), (0.7, 1), (0.2, 0), (0.1, 0)])], "id int, conf double, correct int")
    curve = metrics.risk_coverage(x)
    assert curve.filter("k = 1").first().risk == 0 and metrics.risk_at(curve, 0.6).first().risk == 0
    assert metrics.aurc(curve).first().aurc < 0.3
    assert metrics.auroc(x).first().auroc == 1
    assert metrics.auroc(x.filter("correct = 1")).first().auroc is None
    sharp = spark.range(4000).select(((F.col("id") % 41 - 20) / 4.0).alias("z"), F.col("id").alias("i"))
    u = F.pmod(F.xxhash64("i"), F.lit(100003)) / 100003.0
    sharp = sharp.select((3 * F.col("z")).alias("logit"), (u < 1 / (1 + F.exp(-F.col("z")))).cast("int").alias("correct"))
    assert metrics.temperature(sharp) > 1.5
    assert metrics.temperature(sharp.limit(0)) is None


def test_bootstrap_contains_the_mean(spark):
    x = spark.range(500).select("id", (F.col("id") % 2).cast("double").alias("v"))
    r = metrics.bootstrap_interval(x, "v", "id", 200).first()
    assert r.lo < 0.5 < r.hi and r.hi - r.lo < 0.15


def test_splits(spark):
    ids = spark.range(20).select(F.format_string("v%d", "id").alias("video_id"))
    s = selection.grouped_split(ids, "video_id").cache()
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 12, "val": 4, "test": 4}
    selection.assert_empty(selection.split_leaks(s, "video_id"), "leak")
    with pytest.raises(ValueError):
        selection.assert_empty(selection.split_leaks(s.union(ids.withColumn("split", F.lit("x"))), "video_id"), "leak")
    with pytest.raises(ValueError):
        selection.fixed_split(ids, "video_id", "nothing")
    with pytest.raises(KeyError):
        readers.reader("nothing")


def test_synthetic_items(spark):
    videos, timeline = readers.synthetic(spark)
    pair = videos.filter("split = 'val'")
    items = tasks.build(pair, timeline.join(pair.select("video_id"), "video_id"), [("phase 1", "phase 2")], spark.createDataFrame([("step 1", "phase 1")], "name string, parent string")).cache()
    n = {(r.task, r.sub_type): r.n for r in tasks.histogram(items).collect()}
    assert n[("t3", "rsd")] == 6 + 25 and n[("t2", "phase")] == 2 and n[("t4", "steps")] == 6 and n[("t1", "phase")] == 10
    assert n[("t1", "cross_scale")] == 2 and n[("t1", "contradiction")] == 2 and n[("t6", "interval")] == 2
    assert items.select("id").distinct().count() == items.count()
    early = items.filter("task = 't3'").filter(F.array_max("frames.t_sec") > F.col("probe_t_s"))
    assert early.count() == 0


def test_streams(spark, tmp_path):
    rows = [("a", 0.0, "x"), ("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 0.0, "x"), ("a", 3.0, "x")]
    spark.createDataFrame(rows, "key string, t double, label string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, t double, label string").parquet(str(tmp_path / "in"))
    q = live.live_runs(src).writeStream.format("memory").queryName("live_runs_test").outputMode("append").start()
    end = time.time() + 60
    while time.time() < end and spark.table("live_runs_test").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert {tuple(r) for r in spark.table("live_runs_test").collect()} >= {("a", "x", 0.0, 2.0), ("a", "y", 2.0, 3.0)}
    frames = spark.createDataFrame([("u", "2024-01-01 00:00:05", "x"), ("u", "2024-01-01 00:00:20", "x")], "k string, ts string, label string").withColumn("ts", F.to_timestamp("ts"))
    assert live.label_windows(frames).count() == 3
    assert live.gap_sessions(frames, "k", gap="10 seconds").count() == 2


def test_an_empty_split_raises(spark):
    split = selection.fixed_split(spark.createDataFrame([(f"v{k}", "a") for k in range(9)], "id string, center string"), "id", "all_test")
    assert selection.videos_of(split, "test").count() == 9
    with pytest.raises(ValueError):
        selection.videos_of(split, "val")
    with pytest.raises(ValueError):
        selection.fixed_split(split, "id", "unheard_of")


def test_provenance_is_stable():
    a, b = provenance.provenance(3, {"x": 1, "y": [2, 3]}, note="n"), provenance.provenance(3, {"y": [2, 3], "x": 1})
    assert a["cfg_hash"] == b["cfg_hash"] and len(a["cfg_hash"]) == 12 and a["seed"] == "3" and a["note"] == "n"
    assert provenance.cfg_hash({"x": 2}) != a["cfg_hash"]


def test_synthetic_is_a_source(spark):
    x = readers.reader("synthetic")(spark)
    assert x.columns == readers.TIMELINE and x.select("video_id").distinct().count() == 6


def test_later_results_replace_earlier_ones(spark):
    rows = spark.createDataFrame([("m", "overall", 1.0, "2024-01-02"), ("m", "overall", 9.0, "2024-01-01")], "method string, len_bucket string, miou double, timestamp string")
    assert report.pivot_by_length(rows, "miou", ["method"]).first().overall == 1.0


def test_live_runs_drop_late_frames(spark, tmp_path):
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    taken = {}

    class Frames:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, step, *a):
            assert a[-1] == GroupStateTimeout.ProcessingTimeTimeout
            taken["step"] = step

    class State:
        hasTimedOut, held = False, None
        exists = property(lambda self: self.held is not None)
        get = property(lambda self: self.held)

        def update(self, x):
            self.held = x

        def setTimeoutDuration(self, ms):
            pass

        def remove(self):
            self.held = None

    live.live_runs(Frames())
    state, out = State(), []
    for batch in ([(2, "a"), (1, "a"), (3, "b")], [(2.5, "c"), (0, "c")], [(5, "b"), (4, "b"), (6, "a")]):
        rows = pd.DataFrame(batch, columns=["t", "label"])
        out += [tuple(r) for d in taken["step"](("k",), iter([rows]), state) for r in d.itertuples(index=False)]
    assert out == [("k", "a", 1, 3), ("k", "b", 3, 6)] and state.held == ("a", 6.0, 6.0)
    state.hasTimedOut = True
    assert [tuple(r) for d in taken["step"](("k",), iter([]), state) for r in d.itertuples(index=False)] == [("k", "a", 6.0, 7.0)]
