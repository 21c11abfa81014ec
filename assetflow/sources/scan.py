"""Scans of files by pattern, wildcard or list. Only metadata is read, never content.

Paths come without scheme and host, as patterns name them, whatever file system they are on; ``uri`` keeps both. The order of
assets is that of their paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import named_captures, overlay, positional_captures, whole, wildcard_regex
from ..operators.windows import ranked
from ..schema import EXISTS, PERMANENT
from .store import checkpointed

_SPECIAL = re.compile(r"[\\.^$*+?()\[\]{}|]")


def literal_prefix(pattern: str) -> str:
    """The directory elements before the first one that is a pattern; a backslash before punctuation is literal text."""
    out = []
    for part in pattern.split("/")[:-1]:
        plain = re.sub(r"\\([^a-zA-Z0-9])", r"\1", part)
        if _SPECIAL.search(re.sub(r"\\[^a-zA-Z0-9]", "", part)):
            break
        out.append(plain)
    return "/".join(out) or ("/" if pattern.startswith("/") else ".")


def plain_path(uri: Column) -> Column:
    """Without the scheme and the host of a file system."""
    return F.regexp_replace(uri, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, size, mtime, uri) of the files under ``root``; the content column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("path").alias("uri"))


def as_assets(found: DataFrame, pattern: str, subject: str = "path") -> DataFrame:
    """Asset rows of files whose ``subject`` matches whole, with captures by number and name. Their order is that of their paths,
    unless ``found`` has one."""
    hit = found.where(F.col(subject).rlike(whole(pattern)))
    if "ord" not in found.columns:
        hit = ranked(hit, [F.col("path")], "ord")
    return hit.select(
        "path", "ord", "size", "mtime", F.lit(PERMANENT | EXISTS).cast("long").alias("flags"),
        overlay(positional_captures(F.col(subject), pattern), named_captures(F.col(subject), pattern)).alias("captures"),
    )


def match_elements(found: DataFrame, pattern: str) -> DataFrame:
    """Element by element: as many elements as the pattern has, each matching its own, and then the whole."""
    parts = pattern.split("/")
    own = F.split("path", "/")
    out = found.where(F.size(own) == len(parts))
    for i, p in enumerate(parts):
        try:
            re.compile(re.sub(r"\(\?<([a-zA-Z])", r"(?P<\1", p))
        except re.error:  # a group that spans elements is left to the match of the whole
            continue
        out = out.where(F.get(own, F.lit(i)).rlike(whole(p)))
    return as_assets(out, pattern)


def scan_regex(spark: SparkSession, pattern: str) -> DataFrame:
    """Files whose path matches ``pattern`` element by element. Below the literal directories, only the pattern's last element
    can be a file: if no other is a pattern, no directory below is listed."""
    root = literal_prefix(pattern)
    flat = pattern.count("/") == len([x for x in root.split("/") if x]) + pattern.startswith("/")
    return match_elements(listing(spark, root, not flat), pattern)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each directory holds, one row an entry. A directory that is gone by now holds nothing."""
    for rows in batches:
        for uri in rows["uri"]:
            system, path = fs.FileSystem.from_uri(uri)
            found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            out = [(f"{uri.rstrip('/')}/{quote(x.base_name)}", x.base_name, x.type == fs.FileType.Directory, x.size, x.mtime_ns) for x in found]
            yield pd.DataFrame(out, columns=["uri", "name", "is_directory", "size", "time"]).astype({"size": "Int64", "time": "Int64"})


def frontiers(spark: SparkSession, pattern: str) -> tuple[DataFrame, list[DataFrame]]:
    """(path, size, mtime, uri) of the files at the pattern's depth, and the directories that were listed for it, level by level.
    Each level is listed in tasks and cut by its own element of the pattern, so what the pattern rules out isn't listed, and
    the listing is never with the driver. An element that isn't a pattern by itself (a group that spans several) cuts
    nothing here. For file systems that Arrow opens by URI."""
    root = literal_prefix(pattern)
    parts = pattern.split("/")[len(root.split("/")) if root not in ("/", ".") else (1 if root == "/" else 0) :]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    top = re.sub(r"\Afile:/*", "file:///", system.makeQualified(path).toUri().toString())
    level, listed = spark.createDataFrame([(top,)], "uri string"), []
    for i, part in enumerate(parts):
        listed.append(level)
        spread = level.repartition(spark.sparkContext.defaultParallelism) if i else level
        found = spread.mapInPandas(_entries, "uri string, name string, is_directory boolean, size long, time long")
        try:
            re.compile(re.sub(r"\(\?<([a-zA-Z])", r"(?P<\1", part))
            found = found.where(F.col("name").rlike(whole(part)))
        except re.error:
            pass
        last = i == len(parts) - 1
        found = checkpointed(found.where(~F.col("is_directory") if last else F.col("is_directory")))
        level = found.select("uri")
    stem = plain_path(F.url_decode(F.regexp_replace("uri", r"\+", "%2B")))
    return found.select(stem.alias("path"), "size", F.timestamp_micros((F.col("time") / 1000).cast("long")).alias("mtime"), "uri"), listed


def scan_by_levels(spark: SparkSession, pattern: str) -> DataFrame:
    """``scan_regex`` for trees with many directories that the pattern rules out. The path is absolute."""
    return match_elements(frontiers(spark, pattern)[0], pattern)


def _below(spark: SparkSession, root: str) -> DataFrame:
    """Files with their path below ``root``, which may be a URI."""
    plain = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/", root).rstrip("/")
    return listing(spark, root).withColumn("below", F.regexp_replace("path", "^" + re.escape(plain) + "/", ""))


def scan_recursive(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The path below ``root`` is matched as a whole, at any depth."""
    found = _below(spark, root)
    return as_assets(found, pattern, "below")


def scan_wildcard(spark: SparkSession, root: str, pattern: str, match_all: bool = True) -> DataFrame:
    """``*``, ``?`` and ``#`` on the path below ``root``; without ``match_all`` anywhere in it."""
    found = _below(spark, root)
    return as_assets(found, wildcard_regex(pattern, not match_all), "below")


def listed(lines: DataFrame, assets: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(assets named by the lines, without captures; lines that name none)."""
    names = lines.select(F.trim(line).alias("path")).where("path <> ''").distinct()
    known = assets.join(names, "path", "left_semi").withColumn("captures", F.create_map().cast("map<string,string>"))
    return known, names.join(assets.select("path"), "path", "left_anti")


def scan_list(spark: SparkSession, list_file: str, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return listed(spark.read.text(list_file), assets)
