"""CIDEr without n-grams in the driver."""

import random

import pytest
from test_text_scores import plain_cider

from chronoleaf.operators import text_scores as ts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_grams_or_texts_is_broadcast(spark, tmp_path):
    """A file whose size is far under the threshold for broadcasts has more n-grams than a driver may hold."""
    spark.createDataFrame([(i, f"a b c d {i}", f"a b c e {i}") for i in range(50)], "id long, pred string, ref string").write.parquet(str(tmp_path / "t"))
    plan = plan_of(ts.cider(spark.read.parquet(str(tmp_path / "t")), "id"))
    assert "BroadcastHashJoin" not in plan
    assert plan.count("BroadcastNestedLoopJoin") == 1  # the number of records


def test_cider_of_copies_and_shared_or_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(ts, "PIECE", 300)
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice(["red", "fox", "ran", "over", "it", "the"]) for _ in range(rnd.randint(0, 12)))
    some = [text() for _ in range(9)]
    rows = [(i, rnd.choice(some), rnd.choice(some)) for i in range(80)] + [(100, "", "red fox"), (101, "fox\n ran", "  fox ran\t")]
    got = {r.id: r.cider for r in ts.cider(spark.createDataFrame(rows, "id long, pred string, ref string"), "id").collect()}
    want = plain_cider(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    # records that share a key are one with the n-grams of both, counted one by one; without a key they are one reference more and score 0
    rows = [(1, "a b", "a b c"), (1, "c a", "a b"), (2, "a c", "a b d"), (3, "q", "z"), (None, "a b", "d z"), (None, "d", "d c")]
    got = ts.cider(spark.createDataFrame(rows, "id long, pred string, ref string"), "id").collect()
    assert sorted((r.id or 0) for r in got) == [0, 0, 1, 1, 2, 3] and {r.cider for r in got if r.id is None} == {0.0}
    import math
    from collections import Counter

    grams = lambda texts, n: Counter(tuple(w[i : i + n]) for w in map(str.split, texts) for i in range(len(w) - n + 1))
    p, r = ({k: [row[c] for row in rows if row[0] == k] for k in (1, 2, 3, None)} for c in (1, 2))
    for k in (1, 2, 3):
        total = 0.0
        for n in range(1, 5):
            w = lambda g, n=n: math.log(6) - math.log(max(1, sum(g in grams(t, n) for t in r.values())))
            a, b = grams(p[k], n), grams(r[k], n)
            la, lb = (math.sqrt(sum((c * w(g)) ** 2 for g, c in x.items())) for x in (a, b))
            total += sum(min(c, b[g]) * b[g] * w(g) ** 2 for g, c in a.items()) / (la * lb) if la * lb else 0
        d = sum(grams(p[k], 2).values()) - sum(grams(r[k], 2).values())
        assert all(x.cider == pytest.approx(10 * total / 4 * math.exp(-d * d / 72), abs=1e-9) for x in got if x.id == k)
