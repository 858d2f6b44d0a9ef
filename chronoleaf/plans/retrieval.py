"""Driver queries on the retriever's index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.operators import retrieval, selection
from chronoleaf.plans.base import scratch, stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def searched(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    path = scratch(spark, "vectors")
    retrieval.build(e, "vec_id", "embedding", path)
    return retrieval.search(e.filter("vec_id % 50 = 0"), e, path, "vec_id", "embedding", 5)


@query()
def retrieve_topk_index(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50, through an index of all rows."""
    return searched(spark, sf).select("query", "item", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS queries, 5 * count(*) AS pairs, true AS recall_90 FROM embeddings WHERE vec_id % 50 = 0")
def retrieve_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index finds at least 0.9 of what the exact search over all rows finds."""
    e = table(spark, sf, "embeddings")
    true = stored(selection.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 5), "nearest")
    x = retrieval.recall(searched(spark, sf), true)
    return x.select("queries", "pairs", (F.col("recall") >= 0.9).alias("recall_90"))
