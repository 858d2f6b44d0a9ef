"""The tar data source and the incremental frame index."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from chronoleaf.sources import tar_source
from chronoleaf.streaming import ingest


@pytest.fixture
def rows(spark):
    tar_source.register(spark)
    return spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.to_json(F.struct("id", F.repeat(F.lit("ä"), 40).alias("t"))).alias("json")).repartition(3)


def test_tar_round_trip_splits_shards(spark, rows, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows.write.format("json_tar").option("shard_mb", "0.1").option("split_bytes", "20000").mode("append").save(path)
    shards = sorted((tmp_path / "shards").glob("*.tar"))
    assert all(s.stat().st_size <= 0.1 * 1024 * 1024 + 10240 for s in shards)
    found = spark.read.format("json_tar").load(path)
    assert sorted((r.key, r.json) for r in found.collect()) == sorted((r.key, r.json) for r in rows.collect())
    assert found.rdd.getNumPartitions() > len(shards)
    manifest = [json.loads(x) for f in (tmp_path / "shards").glob("*.manifest") for x in f.read_text().splitlines()]
    assert sum(m["n"] for m in manifest) == 300 and {m["shard"] for m in manifest} == {s.stem for s in shards}
    with tarfile.open(shards[0]) as tar:
        assert all(m.name.endswith(".json") for m in tar)
    assert not list((tmp_path / "shards").glob("_temporary*"))
    rows.limit(5).write.format("json_tar").mode("overwrite").save(path)
    assert spark.read.format("json_tar").load(path).count() == 5


def test_tars_of_others_and_empty_folders(spark, rows, tmp_path):
    with tarfile.open(tmp_path / "plain.tar", "w") as tar:
        for name, text in (("a.json", "{}"), ("manifest.json", "[]"), ("b.txt", "x")):
            (tmp_path / name).write_text(text)
            tar.add(tmp_path / name, name)
    assert [tuple(r) for r in spark.read.format("json_tar").load(str(tmp_path)).collect()] == [("plain", "a", "{}")]
    (tmp_path / "none").mkdir()
    assert spark.read.format("json_tar").load(str(tmp_path / "none")).count() == 0


def test_an_aborted_job_leaves_nothing(spark, rows, tmp_path):
    path = f"file://{tmp_path}/shards"
    broken = rows.withColumn("json", F.when(F.col("key") == "k250", F.raise_error(F.lit("stop"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("json_tar").mode("append").save(path)
    assert not list((tmp_path / "shards").glob("**/*.tar"))


def test_index_reads_only_new_files(spark, tmp_path):
    def put(video, *numbers):
        (tmp_path / "frames" / video).mkdir(parents=True, exist_ok=True)
        for n in numbers:
            (tmp_path / "frames" / video / f"img_{n:04d}.jpg").write_bytes(b"x")

    index, frames = str(tmp_path / "index"), str(tmp_path / "frames")
    meta = spark.createDataFrame([("a", 64, 48, "north")], "video_id string, width int, height int, center string")
    put("a", 1, 2, 3)
    assert ingest.update_frame_index(spark, frames, index, 2.0, meta) == 3
    assert ingest.update_frame_index(spark, frames, index, 2.0, meta) == 0
    put("a", 4)
    put("b", 7)
    assert ingest.update_frame_index(spark, frames, index, 2.0, meta) == 2
    got = {(r.video_id, r.frame_idx, r.t_sec, r.width) for r in spark.read.parquet(index).collect()}
    assert got == {("a", 1, 0.5, 64), ("a", 2, 1.0, 64), ("a", 3, 1.5, 64), ("a", 4, 2.0, 64), ("b", 7, 3.5, None)}
    made = spark.read.json(f"{index}/_provenance/*")
    assert sorted(r.rows for r in made.collect()) == ["2", "3"]
