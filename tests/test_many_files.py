"""Files are written by many tasks."""

from pyspark.sql import functions as F

from chronoleaf.plans import files


def test_files_are_written_by_many_tasks(spark, tmp_path):
    lines = spark.range(64).select(F.col("id").cast("string").alias("video"), F.lit("x").alias("value"))
    files.as_text(lines, str(tmp_path / "out"))
    parts = {p.name.split("-")[1] for p in (tmp_path / "out").rglob("*.txt")}
    assert len(parts) > 1  # AQE would have merged these bytes into one task
