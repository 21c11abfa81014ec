"""Filters, captures and two-valued predicates: an unset value compares false, and its negation true."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(pattern: str) -> str:
    """``pattern`` for a match of the whole value; the dot takes line breaks."""
    return rf"(?s)\A(?:{pattern})\z"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def filter_match(assets: DataFrame, pattern: str = ".*", path: str = "path") -> DataFrame:
    return assets.where(F.col(path).rlike(whole(pattern)))


def filter_not_match(assets: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Assets that don't match; they get no captures from the pattern."""
    return assets.where(~_true(F.col(path).rlike(whole(pattern))))


def group_names(pattern: str) -> dict[str, int]:
    """Names of a pattern's groups and their numbers, from the text of the pattern."""
    out, number, i, in_class = {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            named = re.match(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>", pattern[i:])
            if named or pattern[i + 1 : i + 2] != "?":
                number += 1
                if named:
                    out[named[1]] = number
        i += 1
    return out


def group_count(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<([a-zA-Z])", r"(?P<\1", pattern)).groups


def _group(c: Column, pattern: str, i: int) -> Column:
    """A group's text; a group that took no part is null, as is any group of a value that doesn't match."""
    got = F.regexp_extract(c, whole(pattern), i)
    return F.when(c.rlike(whole(pattern)) & (got != ""), got)


def positional_captures(c: Column, pattern: str) -> Column:
    """Map of ``0`` (the value) to ``n``; groups that took no part are left out."""
    keys = [F.struct(F.lit("0").alias("key"), F.when(c.rlike(whole(pattern)), c).alias("value"))]
    keys += [F.struct(F.lit(str(i)).alias("key"), _group(c, pattern, i).alias("value")) for i in range(1, group_count(pattern) + 1)]
    return F.map_from_entries(F.filter(F.array(*keys), lambda e: e["value"].isNotNull()))


def named_captures(c: Column, pattern: str) -> Column:
    keys = [F.struct(F.lit(n).alias("key"), _group(c, pattern, i).alias("value")) for n, i in group_names(pattern).items()]
    if not keys:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*keys), lambda e: e["value"].isNotNull()))


def overlay(under: Column, over: Column) -> Column:
    """Both maps; values of ``over`` win."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def is_set(c: Column) -> Column:
    return c.isNotNull()


def equals(a: Column, b: Column) -> Column:
    return _true(a == b)


def not_equals(a: Column, b: Column) -> Column:
    return ~equals(a, b)


def like(c: Column, pattern: str) -> Column:
    return _true(c.rlike(whole(pattern)))


def not_like(c: Column, pattern: str) -> Column:
    return ~like(c, pattern)


def is_true(c: Column) -> Column:
    return _true(F.lower(c).isin("1", "true"))


def is_false(c: Column) -> Column:
    return _true(F.lower(c).isin("0", "false"))


def with_is_file(df: DataFrame, files: DataFrame, value: str, path: str = "path", name: str = "is_file") -> DataFrame:
    known = files.select(F.col(path).alias("__path")).distinct()
    return df.join(known, F.col(value) == F.col("__path"), "left").withColumn(name, F.col("__path").isNotNull()).drop("__path")


def with_is_directory(df: DataFrame, files: DataFrame, value: str, path: str = "path", name: str = "is_directory") -> DataFrame:
    """The value is a directory above some file, at any height."""
    parts = F.split(F.col(path), "/")
    above = files.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("__dir"))
    known = above.where("__dir <> ''").distinct()
    return df.join(known, F.rtrim(F.col(value), F.lit("/")) == F.col("__dir"), "left").withColumn(name, F.col("__dir").isNotNull()).drop("__dir")


def branch(*cases: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first true condition; branches nest as values."""
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def wildcard_regex(pattern: str, partial: bool = False) -> str:
    """``*`` any run, ``?`` one character, ``#`` one digit. ``partial`` looks anywhere unless an end is a wildcard."""
    if partial and pattern[:1] not in tuple("*?#") and pattern[-1:] not in tuple("*?#"):
        pattern = f"*{pattern}*"
    return "".join({"*": ".*", "?": ".", "#": "[0-9]"}.get(c, re.escape(c)) for c in pattern)


def wildcard_match(c: Column, pattern: str, any_case: bool = False, partial: bool = False) -> Column:
    return _true(c.rlike(("(?i)" if any_case else "") + whole(wildcard_regex(pattern, partial))))
