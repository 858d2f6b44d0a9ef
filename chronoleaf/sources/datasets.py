"""Dataset descriptions: vocabularies, frame rates and split schemes, read from files instead of built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.operators import selection as sel

DATASET = "dataset string, domain string, centers array<string>, fps double, labels map<string,array<string>>, first_id int, split struct<scheme:string,counts:array<int>>, alias_of string"


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file or line. labels: names by kind in the order of their ids, from first_id (1 if not given).

    A description with alias_of takes what it leaves out from the one it names.
    """
    x = spark.read.schema(DATASET).json(path, recursiveFileLookup=True)
    base = x.filter("alias_of is null").select(*[F.col(c).alias(f"_{c}") for c in x.columns])
    y = x.join(base, F.col("alias_of") == F.col("_dataset"), "left")
    own = ("dataset", "alias_of")
    return y.select("dataset", *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in x.columns if c not in own], "alias_of").withColumn("first_id", F.coalesce("first_id", F.lit(1)))


def vocabulary(datasets: DataFrame) -> DataFrame:
    """dataset, kind, id, name of all labels."""
    x = datasets.select("dataset", "first_id", F.explode("labels").alias("kind", "names"))
    return x.select("dataset", "kind", "first_id", F.posexplode("names").alias("i", "name")).select("dataset", "kind", (F.col("i") + F.col("first_id")).alias("id"), "name")


def chain_edges(datasets: DataFrame, kind: str = "phase") -> DataFrame:
    """dataset, a, b: each label of a kind comes before the next one, for datasets without a graph of their own."""
    v = vocabulary(datasets).filter(F.col("kind") == kind)
    return v.alias("x").join(v.alias("y"), (F.col("x.dataset") == F.col("y.dataset")) & (F.col("x.id") + 1 == F.col("y.id"))).select("x.dataset", F.col("x.name").alias("a"), F.col("y.name").alias("b"))


def split_videos(videos: DataFrame, datasets: DataFrame, dataset: str, key: str = "video_id", **more) -> DataFrame:
    """``videos`` of a dataset with the split its scheme gives."""
    row = datasets.filter(F.col("dataset") == dataset).select("split.*").first()
    if row is None:
        raise KeyError(f"unknown dataset {dataset!r}")
    return sel.fixed_split(videos, key, row.scheme, tuple(row.counts or ()), **more)
