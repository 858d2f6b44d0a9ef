"""Interval joins cut cells with many pairs."""

import random

from pyspark.sql import functions as F

from chronoleaf.operators import timeline


def test_interval_join_cuts_full_cells(spark, monkeypatch):
    monkeypatch.setattr(timeline, "PAIRS", 50)
    rnd = random.Random(4)
    make = lambda n: [(i, t := rnd.uniform(0, 9), t + rnd.uniform(0, 5)) for i in range(n)]
    a, b = make(120), make(90)
    df = lambda rows: spark.createDataFrame(rows, "id long, t0 double, t1 double")
    j = timeline.overlap_join_global(df(a), df(b), 4.0)
    per = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == sum(min(x[2], y[2]) - max(x[1], y[1]) > 0 for x in a for y in b)
    assert len(per) > 40 and max(per) < sum(per) / 10  # as many tasks as the pairs need, though both tables are small
