"""The manifest: a directory dimension and a file fact, as functions from table to table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import keep_latest

KEYS = ["dir_id", "file"]


def split_path(path: Column) -> tuple[Column, Column]:
    """Directory with a trailing slash (none is ``/``) and file name."""
    dir = F.regexp_extract(path, r"(?s)\A(.*/)?[^/]*\z", 1)
    return F.when(dir == "", "/").otherwise(F.regexp_replace(dir, "/+", "/")), F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def extend_directories(directories: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """``directories`` with an id for each new directory of ``paths``. New ids follow the largest; the ranking is cut by a
    hash of the name, so no task sorts all new names."""
    parts = 1024
    new = paths.select(split_path(F.col(path))[0].alias("dir")).distinct().join(directories, "dir", "left_anti").withColumn("__part", F.pmod(F.xxhash64("dir"), F.lit(parts)))
    sizes = new.groupBy("__part").agg(F.count("*").alias("__n"))  # ``parts`` rows at most
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    top = directories.agg(F.coalesce(F.max("dir_id"), F.lit(0)).alias("__top"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy("dir"))
    numbered = new.join(F.broadcast(before), "__part").crossJoin(F.broadcast(top)).select((F.col("__top") + F.col("__before") + at).cast("long").alias("dir_id"), "dir")
    return directories.select("dir_id", "dir").unionByName(numbered)


def split_path_dimension(paths: DataFrame, directories: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with dir_id and file, by directories that hold all of theirs."""
    dir, file = split_path(F.col(path))
    return paths.withColumn("dir", dir).withColumn("file", file).join(directories, "dir").drop("dir")


def upsert(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace; the last change of a key (by ``seq``) wins over the manifest. A null size or time is that of an
    absent file: 0 and 1900-01-01."""
    absent = F.timestamp_seconds(F.lit(-2208988800))
    new = changes.select(*KEYS, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("last_modified", absent).alias("last_modified"), "flags", "seq")
    old = manifest.select(*KEYS, "size", "last_modified", "flags", F.lit(-(1 << 62)).alias("seq"))
    return keep_latest(old.unionByName(new), KEYS, ["seq", "last_modified", "size", "flags"]).drop("seq")


def set_flags(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """Flags of the keys in ``changes``; keys that the manifest doesn't have are ignored."""
    new = changes.groupBy(*KEYS).agg(F.max("flags").alias("__flags"))
    return manifest.join(new, KEYS, "left").withColumn("flags", F.coalesce("__flags", "flags")).drop("__flags").select(*manifest.columns)


def set_all_flags(manifest: DataFrame, flags: int) -> DataFrame:
    return manifest.withColumn("flags", F.lit(flags).cast("long"))


def add_flags(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    more = changes.groupBy(*KEYS).agg(F.bit_or("flags").alias("__flags"))
    return manifest.join(more, KEYS, "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("__flags", F.lit(0)))).drop("__flags").select(*manifest.columns)


def delete(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    return manifest.join(keys.select(*KEYS), KEYS, "left_anti")


def mask(mask: int) -> Column:
    """Zero selects rows without flags, others select rows with all of the bits."""
    return F.col("flags") == 0 if mask == 0 else F.col("flags").bitwiseAND(F.lit(mask)) == mask


def select_mask(manifest: DataFrame, bits: int) -> DataFrame:
    return manifest.where(mask(bits))


def delete_mask(manifest: DataFrame, bits: int) -> DataFrame:
    return manifest.where(~mask(bits))
