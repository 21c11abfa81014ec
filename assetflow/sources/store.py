"""Manifest snapshots, run logs and recovery points in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process (tests), else an
    error, since executors don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="assetflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """A recovery point: the plan above it is cut, and lost executors don't take it along."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("number long, name string, batch long").parquet(f"{root}/pointer")
    except AnalysisException:  # nothing has been written yet
        return None


def write_manifest(files: DataFrame, directories: DataFrame, root: str, batch: int | None = None) -> str:
    """Writes a new snapshot and then points to it; a run that breaks off before leaves the old one in place. ``batch`` is the
    number of the stream's batch that it holds, if any. Writers that overlap can take the same place; the one that finishes last
    finds out, and so does each reader, and it is an error rather than a lost snapshot."""
    spark, name = files.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    files.write.parquet(f"{root}/{name}/file")
    directories.write.parquet(f"{root}/{name}/directory")
    known = _pointers(spark, root)
    number = 0 if known is None else (known.agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(number, name, batch)], "number long, name string, batch long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    _one_at(_pointers(spark, root), root, number)
    return name


def _one_at(pointers: DataFrame, root: str, number: int) -> str:
    """Name of the snapshot at a place, of which there has to be one."""
    names = [r[0] for r in pointers.where(F.col("number") == number).select("name").limit(2).collect()]
    if len(names) > 1:
        raise RuntimeError(f"two writers wrote snapshot {number} of {root}: remove one of their rows from {root}/pointer")
    return names[0]


def newest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Name of the snapshot that was pointed to last; an error if two writers took its place."""
    known = _pointers(spark, root)
    return _one_at(known, root, known.agg(F.max("number")).first()[0]) if known is not None else None


def newest_batch(spark: SparkSession, root: str) -> int | None:
    """The largest number of a stream's batch among the snapshots."""
    known = _pointers(spark, root)
    return known.agg(F.max("batch")).first()[0] if known is not None else None


def read_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, directories) of the newest snapshot."""
    name = newest_snapshot(spark, root)
    return spark.read.parquet(f"{root}/{name}/file"), spark.read.parquet(f"{root}/{name}/directory")


def write_run_log(log: DataFrame, name: str) -> str:
    """A log of its own, or appended to if the name begins with ``+``; returns the path."""
    path = name.removeprefix("+")
    log.write.mode("append" if name.startswith("+") else "overwrite").parquet(path)
    return path
