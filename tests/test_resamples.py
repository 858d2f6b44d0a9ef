"""Bootstrap draws of each resample."""

import hashlib
import math

import numpy as np
import pytest

from chronoleaf.operators import metrics
from chronoleaf.plans import scores


def test_every_resample_draws_for_itself(spark):
    rows = [(i, f"g{i % 2}", float(i % 7)) for i in range(40)] + [(40, "g0", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    n, cuts = 50, np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    draw = lambda i, r: int(np.searchsorted(cuts, int(hashlib.md5(f"draw:0:{r}:{i}".encode()).hexdigest()[:10], 16) / 2**40, side="right"))
    got = {r.g: (r.lo, r.hi) for r in metrics.bootstrap_interval_independent(df, "v", "id", n, by=["g"]).collect()}
    for g in ("g0", "g1"):
        w = [[(draw(i, r), v) for i, k, v in rows if k == g and v is not None] for r in range(n)]
        assert got[g] == pytest.approx(tuple(np.percentile([sum(a * v for a, v in x) / sum(a for a, _ in x) for x in w], [2.5, 97.5])))
    assert "md5('draw:0:' || rep || ':' || event_id)" in scores.ORACLES["bootstrap_ci"]
