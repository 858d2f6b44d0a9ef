"""The closure reads written edges."""

from chronoleaf.plans import summaries


def test_closure_reads_written_edges(spark, sf):
    plan = summaries.graph_closure_trade(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # the join of the tables is not repeated for every level
