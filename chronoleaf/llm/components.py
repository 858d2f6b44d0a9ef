"""Connected components of a table of links, by alternating large and small stars; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoleaf.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long) -> (node, root): every node that has a link to another, with the least node it reaches.

    Each step keys links by a node and points its neighbours at the least of them; rows stay as many as links,
    depth shrinks by the logarithm. A node with many links is pre-aggregated to its least neighbour, written,
    and joined back as a plain join whose large partitions can be split at run time. Tables of a step are deleted
    once the next one is written.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", True)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", True)
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.union(least.filter("k > m").select("k", "m")).filter("u <> v").distinct(), "large-star", True)
        discard(least, edges)
        least = written(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least", True)
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("k", "m")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star", True)
        discard(least, large)
        # a forest of stars: nobody is both a child and a parent, and every child has one parent
        roots = after.select(F.col("v").alias("node")).distinct()
        deep = after.join(roots, F.col("u") == F.col("node"), "left_semi").limit(1).count()
        if not deep and after.count() == after.select("u").distinct().count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        edges = after
