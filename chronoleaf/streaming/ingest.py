"""Incremental ingestion: a frame index that reads only the files it has not seen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from chronoleaf.operators import provenance
from chronoleaf.sources.readers import index_of_paths

#: Columns of Spark's binary files, which a stream has to be told.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def update_frame_index(spark: SparkSession, frames: str, index: str, fps: float = 1.0, meta: DataFrame | None = None, pattern: str = "*.jpg", stamp: Mapping[str, str] | None = None) -> int:
    """Adds the frame files under ``frames`` that earlier calls have not seen to the index at ``index``; how many there were.

    A file stream lists the folder and remembers what it has read in <index>/_checkpoint; one run takes all that is there and
    ends. The index is Parquet by video, whose commits are the stream's own, so a run that dies is taken up by the next
    without a row lost or doubled. A run that added rows leaves its provenance in <index>/_provenance. Only names are
    read. Files must not change under a name; ``meta`` (video_id, width, ...) is joined as it is when a file is first seen.
    """
    x = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(frames).select("path")
    q = index_of_paths(x, fps, meta).writeStream.format("parquet").partitionBy("video_id").option("checkpointLocation", f"{index}/_checkpoint").trigger(availableNow=True).start(index)
    q.awaitTermination()
    new = sum(p["numInputRows"] for p in q.recentProgress)
    if new:
        made = dict(stamp or provenance.provenance(0)) | {"frames": frames, "fps": str(fps), "rows": str(new)}
        provenance.write_beside(made, spark, index)
    return new
