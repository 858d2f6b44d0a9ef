"""Times are rounded as SQL rounds them."""

import numpy as np
from pyspark.sql import functions as F

from chronoleaf.functions import answers, intervals


def test_times_round_as_sql_does(spark):
    below = [float(np.nextafter(x, 0)) for x in (0.05, 0.15, 0.35, 1234.55, 8.45, 77.05, 20000.65)]
    v = [*below, 0.05, 0.25, 2.449, 0.0, 0.45, 1e15, 123456.75]
    duck = __import__("duckdb").connect()
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for r in df.select("x", answers.format_ts(F.col("x")).alias("t"), intervals.round1(F.col("x")).alias("r")).collect():
        assert (r.t, r.r) == duck.execute("SELECT printf('%.1f', round(x, 1)), round(x, 1) FROM (SELECT ?::DOUBLE AS x)", [r.x]).fetchone()
    assert [tuple(r) for r in df.limit(1).select(answers.format_ts(F.lit(-2.0)), answers.format_ts(F.lit(None).cast("double"))).collect()] == [("0.0", "0.0")]
