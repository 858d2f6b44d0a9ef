"""Exact search within labels."""

import random

import numpy as np

from chronoleaf.operators import selection


def test_search_within_labels_compares_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    rows = [(i, x.tolist(), None if i % 50 == 7 else f"l{i % 3}") for i, x in enumerate(v)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    x = selection.nearest(e.filter("vec_id % 5 = 0"), e, "vec_id", "vec_id", "embedding", 4, (7, 16), within="label")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 5):
        near = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if i != q and rows[i][2] is not None and rows[i][2] == rows[q][2])
        want |= {(q, i, k) for k, (_, i) in enumerate(near[:4], 1)}
    assert {(r["query"], r["item"], r["rank"]) for r in x.collect()} == want
    assert "aggregate(" not in x._jdf.queryExecution().optimizedPlan().toString()
