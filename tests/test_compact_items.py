"""Items are numbered as short rows; frame times and prompts are added after."""

import random

from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.functions import intervals as iv
from chronoleaf.operators import tasks


def test_frame_times_and_prompts_equal_plain_ones(spark):
    rnd = random.Random(8)
    rows = [(0.0, 0.0), (5.0, 1.0), (0.0, 0.05), (None, None), (2e15, 3e15), *[(a := rnd.uniform(0, 1e5), a + rnd.uniform(0, 300)) for _ in range(300)]]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    plain = iv.sample_times(F.col("a"), F.col("b"), tasks.N_FRAMES)
    text = F.array_join(F.transform(plain, lambda t: an.format_ts(t)), ", ")
    x = df.select("a", plain.alias("want"), text.alias("text"), tasks.sampled("a", "b").alias("f")).select("*", tasks.shown_times("f.t_sec").alias("again"))
    for r in x.collect():
        assert (r.f.t_sec, r.f.shown, r.again) == (r.want, r.text, r.text)


def test_items_are_numbered_before_their_times(spark):
    videos = spark.createDataFrame([("d", "v", 1000.0, "log", None)], "dataset string, video_id string, duration_s double, domain string, center string")
    rows = [("d", "v", "phase", i, None, "ab"[i % 2], i * 100.0, i * 100.0 + 100) for i in range(10)]
    line = spark.createDataFrame(rows, "dataset string, video_id string, kind string, run_id int, label_id int, label string, t0 double, t1 double")
    x = tasks.build(videos, line)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Window [")  # parents come first
    got = {r.id: r for r in x.collect()}
    assert [got[f"d-v-t3-{k:06d}"].probe_t_s for k in (1, 2, 3)] == [300.0, 600.0, 900.0]
    assert got["d-v-t3-000001"].messages[1].content.startswith("Frames sampled at t = [0.0, 4.8, ") and got["d-v-t3-000001"].frames.window == [0.0, 300.0]
    assert all(len(r.frames.t_sec) == 64 and len(r.messages) == 3 for r in got.values())
