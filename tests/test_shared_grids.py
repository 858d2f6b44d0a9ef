"""Equal spans of a batch share one grid; videos are dealt out before their probes are made."""

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from chronoleaf.operators import tasks


def test_equal_spans_are_sampled_once(monkeypatch):
    asked = []
    real = tasks.grids
    monkeypatch.setattr(tasks, "grids", lambda x, y, known: (asked.append(len(x)), real(x, y, known))[1])
    a, b = [0.0, 5.0, None, 0.0, -0.0] * 100, [300.0, 1.0, None, 300.0, 300.0] * 100
    got = tasks.sampled.func(pa.array(a, pa.float64()), pa.array(b, pa.float64()))
    assert asked == [4]
    for x, y, r in zip(a[:5], b[:5], got.to_pylist()[:5], strict=True):
        one = tasks.sampled.func(pa.array([x], pa.float64()), pa.array([y], pa.float64())).to_pylist()[0]
        assert struct.pack("d", r["t_sec"][0] or 0) == struct.pack("d", one["t_sec"][0] or 0) and r == one


def test_arrays_that_agree_at_their_ends_only_differ():
    rows = [[0.0, 1.0, 9.0], [0.0, 2.0, 9.0], [0.0, 1.0, 9.0], [], None, [4.25], [0.0, 2.0, 9.0], [0.0, 9.0], []]
    got = tasks.shown_times.func(pa.array(rows, pa.list_(pa.float64()))).to_pylist()
    assert got == ["0.0, 1.0, 9.0", "0.0, 2.0, 9.0", "0.0, 1.0, 9.0", "", "", "4.3", "0.0, 2.0, 9.0", "0.0, 9.0", ""]
    part = pa.array(rows, pa.list_(pa.float64())).slice(1, 6)
    assert tasks.shown_times.func(part).to_pylist() == got[1:7]
    assert tasks.shown_times.func(pa.array([[], None], pa.list_(pa.float64()))).to_pylist() == ["", ""]


def test_probes_of_a_small_file_are_made_by_many_tasks(spark):
    x = spark.createDataFrame([("d", f"v{i}", 90000.0, "log", None) for i in range(40)], "dataset string, video_id string, duration_s double, domain string, center string").coalesce(1)
    made = tasks.duration_items(x).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(made) >= 4 and sum(r["count"] for r in made) == 40 * 299
