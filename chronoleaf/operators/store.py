"""Tables that a plan writes for itself: the folder that driver and executors share, and what is deleted when."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; its file system is the setting's own.

    Where that is unset, a local session uses /tmp/checkpoints and any other one the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "/tmp/checkpoints" if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once for plans that read it many times; a lost executor costs a read, not the plan before it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
