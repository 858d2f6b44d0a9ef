"""Runs without hash tables."""

import random

from chronoleaf.operators import timeline


def test_runs_need_no_hash_tables(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.randint(0, 60), rnd.choice(["a", "b", None])) for k in range(4) for _ in range(60)] + [(9, None, "a"), (9, 3, "a"), (9, 3, "a")]
    df = spark.createDataFrame(rows, "k long, at long, l string")
    for least in (1, 2, 3):
        x = timeline.consecutive_runs(df, ["k"], "at", "l", least)
        want = []
        for k, label in {(r[0], r[2]) for r in rows if r[2]}:
            at = sorted({r[1] for r in rows if r[0] == k and r[2] == label and r[1] is not None})
            starts = [i for i, p in enumerate(at) if not i or at[i - 1] != p - 1]
            want += [(k, label, at[i], at[j - 1] + 1) for i, j in zip(starts, [*starts[1:], len(at)], strict=True) if at[j - 1] + 1 - at[i] >= least]
        assert sorted(map(tuple, x.collect())) == sorted(want)
        assert "Aggregate" not in x._jdf.queryExecution().optimizedPlan().toString()
