"""Result cells of the families whose records are more than one row of values."""

import pytest
from pyspark.sql import functions as F

from chronoleaf.operators import evaluate, graph, metrics, report


def test_summary_cells_with_references(spark):
    rows = [("m", 1, "a then b", ["a", "b"], 60.0, "a then b"), ("m", 2, "b then a", ["a", "b"], 4000.0, "a then b"), ("n", 1, "", ["a"], 60.0, "c")]
    x = spark.createDataFrame(rows, "method string, item long, pred string, names array<string>, duration_s double, gold string")
    reach = spark.createDataFrame([("a", "b")], "a string, b string")
    got = {(r.method, r.len_bucket): r for r in evaluate.summary_family(x, reach, ["method"]).collect()}
    every = got["m", "overall"]
    assert (every.n_items, every.summ_order_violation_rate, every.summ_coverage_recall, every.summ_hard_order_violations) == (2, 0.5, 1.0, 1.0)
    assert got["m", "<30min"].summ_order_violation_rate == 0 and got["m", "60-120min"].summ_order_violation_rate == 1
    assert got["m", "<30min"].summ_meteor > got["m", "60-120min"].summ_meteor and got["n", "overall"].summ_cider == 0


def test_cells_of_several_families_come_together(spark):
    a = spark.createDataFrame([("m", "overall", 3, 0.5), ("m", "<30min", 3, None)], "method string, len_bucket string, n_items long, edit double")
    b = spark.createDataFrame([("m", "overall", 0.25), ("k", "overall", 0.75)], "method string, len_bucket string, ece double")
    cells = evaluate.family_cells([a, b]).withColumn("provenance", F.create_map().cast("map<string,string>"))
    rows = {(r.method, r.len_bucket): (r.edit, r.ece, r.n_items) for r in report.flatten(cells).collect()}
    assert rows == {("m", "overall"): (0.5, 0.25, 3.0), ("m", "<30min"): (None, None, 3.0), ("k", "overall"): (None, 0.75, None)}


def test_reliability_of_a_cell_equals_that_of_its_records(spark):
    x = spark.range(600).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("method"), "id", (F.col("id") * 7919 % 97 / 97.0).alias("conf"), (F.col("id") % 5 < 3).cast("double").alias("correct"), F.lit(60.0).alias("duration_s"))
    got = {r.method: r for r in evaluate.reliability_family(x, ["method"], "id").filter("len_bucket = 'overall'").collect()}
    for k in "ab":
        want = evaluate.reliability_bundle(x.filter(F.col("method") == k), "id").first()
        assert [got[k][c] for c in ("ece", "ece_adapt", "aurc", "risk@0.8cov", "conf_auroc", "n_items")] == pytest.approx([want[c] for c in ("ece", "ece_adapt", "aurc", "risk@0.8cov", "conf_auroc", "n")])


def test_violation_counts_equal_the_listed_pairs(spark):
    rows = [(v, i, "abcd"[(i * 7 + v * 3) % 4], float(i), float(i + 1)) for v in range(6) for i in range(1, 12)] + [(9, 1, "z", 0.0, 1.0)]
    x = spark.createDataFrame(rows, "video long, run_id long, label string, t0 double, t1 double")
    reach = graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string"))
    listed = {r.video: r.n for r in graph.violations(x, reach, ["video"]).groupBy("video").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.video: r.n_violations for r in graph.violation_counts(x, reach, ["video"]).collect()}
    own = {r.video: r.n for r in graph.violations(x, reach, ["video"]).filter("first = second").groupBy("video").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {v: listed.get(v, 0) - own.get(v, 0) for v in [*range(6), 9]}
    assert metrics.TOTAL == "overall"
