"""The exact search takes every row of its table, and keeps what is best over many blocks."""

import numpy as np

from chronoleaf.operators import selection
from chronoleaf.plans import registry
from chronoleaf.plans.base import table


def test_every_row_is_searched_for_among_all_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label").toPandas()
    got = registry.queries()["retrieve_topk_cosine"](spark, sf).toPandas()
    assert len(got) == 5 * len(e) and set(got["query"]) == set(e["vec_id"])
    label = e.set_index("vec_id")["label"]
    assert (label.loc[got["query"]].to_numpy() != label.loc[got["item"]].to_numpy()).any()


def test_best_items_of_many_blocks_with_ties(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, size=(260, 4)).astype(float)  # many equal directions, some zero vectors
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    n = np.linalg.norm(v, axis=1)
    want = set()
    for q in np.flatnonzero(n > 0):
        near = sorted((-round(float(v[q] @ v[i] / (n[q] * n[i])), 9) + 0.0, int(i)) for i in np.flatnonzero(n > 0) if i != q)
        want |= {(int(q), i, k) for k, (_, i) in enumerate(near[:6], 1)}
    for block in ((40, 16), (300, 5), (7, 300)):
        x = selection.nearest(e, e, "vec_id", "vec_id", "embedding", 6, block)
        assert {(r["query"], r["item"], r["rank"]) for r in x.collect()} == want
