"""Live runs by event time: the same for any batching within the watermark."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronoleaf.streaming import live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key string, ts timestamp, label string"


def plain_runs(frames, gap=60, unit=1):
    """(key, label, t0, t1) in seconds of all frames at once."""
    out = []
    for key in {k for k, _, _ in frames}:
        run = None
        for t, label in sorted((t, x) for k, t, x in frames if k == key):
            if run and (t - run[2] > gap or run[0] != label):
                out.append((key, run[0], run[1], run[2] + unit if t - run[2] > gap else t))
                run = None
            run = (label, run[1] if run else t, t)
        out.append((key, run[0], run[1], run[2] + unit))
    return sorted(out)


def streamed(spark, tmp_path, name, batches):
    """The runs of a stream that reads one file of frames a batch."""
    folder = tmp_path / name
    for i, b in enumerate([*batches, [("end", 5000, "z")], [("end", 9000, "z")], [("end", 9001, "z")]]):
        rows = [(k, START + timedelta(seconds=t), x) for k, t, x in b]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"batch={i}"))
        time.sleep(0.02)
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    q = live.event_runs(src, "2 minutes").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    found = spark.table(name).filter("key <> 'end'").select("key", "label", F.unix_seconds("t0") - int(START.timestamp()), F.unix_seconds("t1") - int(START.timestamp())).collect()
    return sorted(tuple(r) for r in found)


@pytest.mark.parametrize("seed", [1])
def test_runs_do_not_depend_on_batches(spark, tmp_path, seed):
    rnd = random.Random(seed)
    frames = []
    for key in "ab":
        t = 0
        while t < 900:
            t += rnd.choice([1, 2, 5, 20, 90])
            frames.append((key, t, rnd.choice("xxy")))
    late = lambda spread: sorted(frames, key=lambda f: f[1] + rnd.uniform(0, spread))
    cut = lambda rows, n: [rows[i : i + n] for i in range(0, len(rows), n)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        want = plain_runs(frames)
        for name, batches in (("few", cut(late(0), 60)), ("many_late", cut(late(100), 17))):
            assert streamed(spark, tmp_path, name, batches) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
