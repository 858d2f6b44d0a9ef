"""Text scores against plain versions, the vector index against the exact search."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoleaf.operators import retrieval, selection
from chronoleaf.operators import text_scores as ts
from chronoleaf.operators.store import scratch


def plain_chunks(pred, ref):
    """The most matches and the fewest runs over all one-to-one alignments of equal words."""
    best = (0, 0)

    def walk(i, used, pairs):
        nonlocal best
        if i == len(pred):
            runs = sum(k == 0 or pairs[k - 1] != (a - 1, b - 1) for k, (a, b) in enumerate(pairs))
            if len(pairs) > best[0] or len(pairs) == best[0] and runs < best[1]:
                best = (len(pairs), runs)
            return
        walk(i + 1, used, pairs)
        for j, w in enumerate(ref):
            if w == pred[i] and j not in used:
                walk(i + 1, used | {j}, [*pairs, (i, j)])

    walk(0, frozenset(), [])
    return best


@pytest.mark.parametrize("seed", range(3))
def test_fewest_chunks_equals_all_alignments(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        p, r = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        assert ts.fewest_chunks(p, r, beam=10_000) == plain_chunks(p, r)
        assert ts.fewest_chunks(p, r)[0] == plain_chunks(p, r)[0]


def test_meteor(spark):
    rows = [(1, "the cat sat on the mat", "on the mat sat the cat"), (2, "a b c", "a b c"), (3, "x", "y"), (4, None, "y"), (5, "", ""), (6, "A b", "a B c d")]
    got = {r.id: r for r in ts.meteor(spark.createDataFrame(rows, "id long, pred string, ref string"), "id").collect()}
    assert (got[1].matches, got[1].chunks) == (6, 3)
    assert got[1].meteor == pytest.approx(1 - 0.6 * 0.5**0.2)
    assert got[2].meteor == pytest.approx(1 - 0.6 * (1 / 3) ** 0.2)
    p, r = 1.0, 0.5
    assert got[6].meteor == pytest.approx(p * r / (0.85 * p + 0.15 * r) * (1 - 0.6 * 0.5**0.2))
    assert [got[i].meteor for i in (3, 4, 5)] == [0, 0, 0]


def plain_cider(rows):
    grams = lambda t: Counter(" ".join(w[i : i + n]) + f"#{n}" for w in [(t or "").split()] for n in range(1, 5) for i in range(len(w) - n + 1))
    size = len(rows)
    df = Counter(g for _, _, r in rows for g in grams(r))
    out = {}
    for k, p, r in rows:
        gp, gr, total = grams(p), grams(r), 0.0
        for n in range(1, 5):
            weigh = lambda c, n=n: {g: v * (math.log(size) - math.log(max(1, df[g]))) for g, v in c.items() if g.endswith(f"#{n}")}
            a, b = weigh(gp), weigh(gr)
            la, lb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
            total += sum(min(v, b.get(g, 0)) * b.get(g, 0) for g, v in a.items()) / (la * lb) if la * lb else 0
        d = sum(v for g, v in gp.items() if g.endswith("#2")) - sum(v for g, v in gr.items() if g.endswith("#2"))
        out[k] = 10 * total / 4 * math.exp(-d * d / 72)
    return out


def test_cider_equals_plain_version(spark):
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(["red", "fox", "ran", "over", "it", "the"]) for _ in range(rnd.randint(0, 12)))
    rows = [(i, text(), text()) for i in range(60)] + [(90, None, "a b"), (91, "a b", None), (92, "same words here again", "same words here again")]
    got = {r.id: r.cider for r in ts.cider(spark.createDataFrame(rows, "id long, pred string, ref string").withColumns({"n": F.lit(1), "g": F.lit("x"), "s": F.lit(2)}), "id").collect()}
    want = plain_cider(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_index_finds_near_rows_in_few_lists(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 24))
    v = centres[rng.integers(0, 60, 4000)] + 0.25 * rng.normal(size=(4000, 24))
    v[1000:2200] = v[1000] + 0.01 * rng.normal(size=(1200, 24))  # one list holds a third of the rows
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (9000, None), (9001, [0.0] * 24), (9002, [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = scratch(spark, "index")
    model = retrieval.build(df, "vec_id", "embedding", path)
    assert model.probes <= 0.3 * len(model.centroids)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 4000 and blocks.agg(F.max(F.size("ids"))).first()[0] < 2 * retrieval.BLOCK
    q = df.filter("vec_id % 50 = 0")
    found = retrieval.search(q, df, path, "vec_id", "embedding").cache()
    exact = selection.nearest(q, df.filter(F.size("embedding") == 24), "vec_id", "vec_id", "embedding", 5)
    assert retrieval.recall(found, exact).first().recall >= 0.9
    assert found.count() == 5 * 80 and not found.filter("query = item").count()
    both = found.join(exact, ["query", "item"]).select(found["score"], exact["score"].alias("s")).collect()
    assert all(a == b for a, b in both)


def test_index_of_no_rows(spark):
    with pytest.raises(ValueError, match="no vectors"):
        retrieval.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id", "embedding", scratch(spark, "index"))
