"""What a run was made with, as far as Spark knows it: stamped on result cells and written beside tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(settings: Mapping, above: str = "") -> Iterator[str]:
    """One line "path = value" for each leaf of nested settings."""
    for name, value in settings.items():
        path = f"{above}.{name}" if above else str(name)
        if isinstance(value, Mapping):
            yield from flat(value, path)
        else:
            yield f"{path} = {value!r}"


def cfg_hash(cfg: Mapping) -> str:
    """12 hex digits that are the same for equal settings, whatever their order."""
    return hashlib.sha1("\n".join(sorted(flat(cfg))).encode()).hexdigest()[:12]


def session_facts(spark: SparkSession) -> dict[str, str]:
    """The application, Spark's version and a hash of the SQL settings, which decide how a plan runs."""
    sql = {r.key: r.value for r in spark.sql("SET").collect() if r.key.startswith("spark.sql.")}
    return {"application": spark.sparkContext.applicationId, "spark": spark.version, "settings": cfg_hash(sql)}


def provenance(seed: int, cfg: Mapping | None = None, inputs: Sequence[DataFrame] = (), commit: str = "n/a", **extra: object) -> dict[str, str]:
    """What stamps hold, as text: facts of the active session, the files that ``inputs`` read, and what the caller passes.

    The commit of the code is the caller's to pass; no process is started for it.
    """
    spark = SparkSession.getActiveSession()
    facts = session_facts(spark) if spark else {}
    folders = sorted({f.rsplit("/", 1)[0] for df in inputs for f in df.inputFiles()})
    made = {"made_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "seed": seed, "cfg_hash": cfg_hash(cfg or {}), "git_sha": commit, "inputs": " ".join(folders)}
    return {k: str(v) for k, v in {**facts, **made, **extra}.items()}


def as_column(stamp: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in stamp.items() for x in pair])


def stamped(cells: DataFrame, stamp: Mapping[str, str]) -> DataFrame:
    return cells.withColumn("provenance", as_column(stamp))


def write_beside(stamp: Mapping[str, str], spark: SparkSession, path: str) -> None:
    """The stamp as one JSON row in <path>/_provenance, which readers of the table skip."""
    spark.range(1).select(as_column(stamp).alias("p")).select(*[F.col("p")[k].alias(k) for k in stamp]).coalesce(1).write.mode("append").json(f"{path}/_provenance")
