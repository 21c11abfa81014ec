"""Order, distinct rows and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import replace_regex


def ordered_distinct(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.dropDuplicates([path]).orderBy(path)


def lookup_one(files: DataFrame, dir: str, file: str) -> DataFrame:
    return files.where((F.col("dir") == dir) & (F.col("file") == file)).limit(1)


def lookup_many(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The batch form: one row for each key that is found."""
    return keys.dropDuplicates(["dir", "file"]).join(files.dropDuplicates(["dir", "file"]), ["dir", "file"])


def ordered_replace(c: Column, replacements: dict[int | None, tuple[str, str]]) -> Column:
    """Patterns in the order of their numbers; the one without a number comes first."""
    return reduce(lambda out, k: replace_regex(out, *replacements[k]), sorted(replacements, key=lambda k: -1 if k is None else k), c)


def union_all(*branches: DataFrame) -> DataFrame:
    """Outputs of parallel branches; duplicates stay until they are checked."""
    return reduce(DataFrame.unionByName, branches)


def add_input(own: DataFrame | None, upstream: DataFrame | None, plus: bool) -> DataFrame:
    """Own initial input with ``plus`` joins what comes from upstream; without it, own input replaces it."""
    if own is None:
        return upstream
    return own.unionByName(upstream) if plus and upstream is not None else own


def distinct_missing(missing: DataFrame, process: str = "process") -> DataFrame:
    return missing.select(process, "dependency").distinct()
