"""Ranks by ranges, joins by dyadic cells, edit distances, resampled sums, closures and SQL functions against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoleaf.functions import answers, intervals, sql
from chronoleaf.operators import graph, metrics, provenance, selection, timeline
from chronoleaf.operators.ranks import ranked


def test_ranks_over_all_rows_and_of_a_hot_key(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice([1.0, 1.0, 2.5, None]), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v double, w long").repartition(7)
    every = ranked(df, [F.desc("v"), "id"], rank="r", sums={"s": "w"}, count="n").collect()
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    total, want = 0, {}
    for k, r in enumerate(order, 1):
        total += r[3]
        want[r[0]] = (k, total, len(rows))
    assert {r.id: (r.r, r.s, r.n) for r in every} == want
    seen, want = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: r[0]):
        seen[r[1]].append(r)
        want[r[0]] = (len(seen[r[1]]), sum(x[3] for x in seen[r[1]]))
    by = ranked(df, ["id"], by=["k"], sums={"s": "w"}, count="n").collect()
    assert {r.id: (r["rank"], r.s) for r in by} == want and all(r.n == len(seen[r.k]) for r in by)
    assert ranked(df.limit(0), ["id"]).count() == 0


def test_one_confidence_spreads_over_tasks(spark):
    df = spark.range(4000).select("id", F.lit(0.9).alias("conf"), (F.col("id") % 3 == 0).cast("double").alias("correct"))
    curve = metrics.risk_coverage(df)
    assert curve.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    last = curve.orderBy(F.desc("k")).first()
    assert (last.k, last.n) == (4000, 4000) and last.risk == pytest.approx(2666 / 4000)
    sizes = [r.n for r in metrics.adaptive_bins(df, "id", n_bins=7).collect()]
    assert sorted(sizes) == [571] * 4 + [572] * 3
    assert metrics.auroc(df).first().auroc == pytest.approx(0.5)


def test_no_plan_ranks_rows_in_one_place(spark):
    df = spark.range(100).select("id", F.col("id").alias("conf"), F.lit(1.0).alias("correct"), F.lit(1).alias("size"))
    for x in (selection.keep_recent(df, "size", "conf", "id", 10), selection.grouped_split(df, "id"), metrics.risk_coverage(df), metrics.adaptive_bins(df, "id")):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [row_number() " not in plan  # what is left are sums over one row a range


def test_interval_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    make = lambda n: [(i, t := rnd.uniform(-500, 5000), t + rnd.choice([0.0, 0.5, 3.0, 40.0, 700.0, 6000.0]) * rnd.random()) for i in range(n)]
    a, b = [*make(150), (900, 10.0, 10.0), (901, 0.0, 8.0), (902, 8.0, 16.0)], [*make(150), (903, 8.0, 16.0), (904, 16.0, 16.0)]
    df = lambda rows: spark.createDataFrame(rows, "id long, t0 double, t1 double")
    got = Counter((r.l.id, r.r.id) for r in timeline.overlap_join_global(df(a), df(b), 4.0).collect())
    want = Counter((x[0], y[0]) for x in a for y in b if min(x[2], y[2]) - max(x[1], y[1]) > 0)
    assert got == want
    assert timeline.overlap_join_global(df([]), df(b), 4.0).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.choice([2, 5, 400])
        a, b = ([rnd.randint(0, n) for _ in range(rnd.randint(0, 80))] for _ in range(2))
        assert metrics.edit_distance(a, b) == plain_distance(a, b)


def test_edit_score_of_many_labels_and_long_runs(spark):
    rows = [("v", "pred", 1, 0), ("v", "gt", 1, 256), *[("w", s, i, i % 300) for s in ("pred", "gt") for i in range(100_000) if s == "gt" or i % 1000], ("x", "gt", 1, 5)]
    df = spark.createDataFrame(rows, "video string, side string, run_id long, code int")
    got = {r.video: r.edit for r in metrics.edit_score(df, ["video"], "pred", "gt").collect()}
    assert got == {"v": 0.0, "w": pytest.approx(99.9), "x": 0.0}


def test_bootstrap_sums_equal_plain_resamples(spark):
    import hashlib

    rows = [(i, f"g{i % 2}", float(i % 7)) for i in range(40)] + [(40, "g0", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    n, cuts = 50, np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    got = {r.g: (r.lo, r.hi) for r in metrics.bootstrap_interval(df, "v", "id", n, by=["g"]).collect()}
    for g in ("g0", "g1"):
        means = []
        for r in range(n):
            w = {}
            for i, k, v in rows:
                if k == g and v is not None:
                    h = hashlib.md5(f"draw:0:{i}".encode()).hexdigest()
                    a, b, c = (int(h[7 * j : 7 * j + 7], 16) for j in range(3))
                    w[i] = int(np.searchsorted(cuts, (a + b * r + c * r * r) % metrics.PRIME / metrics.PRIME, side="right"))
            means.append(sum(rows[i][2] * x for i, x in w.items()) / sum(w.values()))
        assert got[g] == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)))


def test_closures_agree(spark):
    rnd = random.Random(6)
    for _ in range(3):
        edges = {(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(9)}
        df = spark.createDataFrame([*edges, (1, None)], "a long, b long")
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        assert {tuple(r) for r in graph.closure(df).collect()} == reach == {tuple(r) for r in graph.closure_by_doubling(df).collect()}


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    said = ["<answer>[12.5, 01:10]</answer>", "<answer>[[1, 2], [9, 3s]]</answer>", "no idea", "<answer>abstain</answer>", "[x, 3]", None, " [1:00:00, 5] "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id long, t string")
    want = {r.id: r.p for r in df.select("id", answers.parse_answer(F.col("t")).alias("p")).collect()}
    assert {r.id: r.p for r in spark.sql("SELECT id, parse_answer(t) AS p FROM {df}", df=df).collect()} == want
    rows = spark.createDataFrame([(0.0, 2.0, 1.0, 3.0), (0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 1.0, 1.0), (0.0, 5400.0, 60.0, 9000.0)], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    want = rows.select(intervals.tiou(*cols), intervals.hull_iou(*cols), intervals.length_bucket(cols[3]), intervals.regime(cols[1], F.lit("which Hook"))).collect()
    got = spark.sql("SELECT tiou(a, b, c, d), hull_iou(a, b, c, d), length_bucket(d), regime(b, 'which Hook') FROM {rows}", rows=rows).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_stamps_lie_beside_their_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    made = provenance.provenance(7, {"a": {"b": 1}}, [spark.read.parquet(path)], commit="abc", note="n")
    assert made["inputs"].endswith("/t") and made["git_sha"] == "abc" and made["application"] == spark.sparkContext.applicationId
    provenance.write_beside(made, spark, path)
    assert spark.read.parquet(path).count() == 3
    assert spark.read.json(f"{path}/_provenance/*").first().seed == "7"
