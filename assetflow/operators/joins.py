"""Joins of assets, outputs, edges and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXISTS, FORCED, TEMPORARY
from ..sources.store import checkpointed


def join_dependencies(outputs: DataFrame, dependencies: DataFrame, key: str = "transition_id") -> DataFrame:
    """Each transition's outputs with each of its dependencies, as edges."""
    return outputs.join(dependencies, key)


def enrich_state(outputs: DataFrame, assets: DataFrame, output: str = "output") -> DataFrame:
    """EXISTS and the time of change where the output is among the assets."""
    seen = assets.select(F.col("path").alias("__path"), F.col("mtime").alias("__mtime"))
    joined = outputs.join(seen, F.col(output) == F.col("__path"), "left")
    return joined.withColumn("flags", F.when(F.col("__path").isNotNull(), F.col("flags").bitwiseOR(F.lit(EXISTS))).otherwise(F.col("flags"))).withColumn("mtime", F.col("__mtime")).drop("__path", "__mtime")


def missing_inputs(dependencies: DataFrame, assets: DataFrame) -> DataFrame:
    """(transition_id, dependency) that are absent when the work is due; temporaries that aren't forced don't count."""
    due = dependencies.where((F.col("flags").bitwiseAND(F.lit(TEMPORARY)) == 0) | (F.col("flags").bitwiseAND(F.lit(FORCED)) != 0))
    return due.join(assets.select(F.col("path").alias("dependency")), "dependency", "left_anti").select("transition_id", "dependency").distinct()


def add_dependencies(transitions: DataFrame, extra: list[str], assets: DataFrame) -> DataFrame:
    """The block's extra dependencies for every transition; one that isn't among the assets is an error. The list is part of
    the pipeline's text, so it is written into the rows rather than joined."""
    found = {r[0] for r in assets.where(F.col("path").isin(extra)).select("path").distinct().collect()}  # len(extra) at most
    if lost := [x for x in extra if x not in found]:
        raise FileNotFoundError(f"dependency doesn't exist: {lost[0]}")
    return transitions.withColumn("dependency", F.explode(F.array(*[F.lit(x) for x in extra])))


def manifest_join(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Files with their full path."""
    return files.join(directories, "dir_id").withColumn("path", F.concat("dir", "file"))


def prune_directories(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Directories that still have a file."""
    return directories.join(files.select("dir_id"), "dir_id", "left_semi")


def cascade_delete(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files that aren't in a deleted directory."""
    return files.join(deleted.select("dir_id"), "dir_id", "left_anti")


def depends_on_all(transitions: DataFrame, assets: DataFrame, edges: bool = False) -> DataFrame:
    """Each transition with the one aggregate of all filtered assets: their number, newest change and a digest of their paths
    and places. On demand the edges themselves (transition, dependency, dep_ord), which are the product of both tables."""
    if edges:
        return transitions.crossJoin(assets.select(F.col("path").alias("dependency"), F.col("ord").alias("dep_ord")))
    digest = F.bit_xor(F.xxhash64("path", "ord")).alias("digest")
    one = assets.agg(F.count("*").alias("n_dependencies"), F.max("mtime").alias("newest_dependency"), digest)
    return transitions.crossJoin(F.broadcast(one))  # one row


def remains(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the earlier manifest that are no output now."""
    return before.join(now.select(key), key, "left_anti")


def with_exists(df: DataFrame, assets: DataFrame, value: str, name: str = "exists") -> DataFrame:
    """``true`` or ``false`` as text."""
    seen = assets.select(F.col("path").alias("__path")).distinct()
    return df.join(seen, F.col(value) == F.col("__path"), "left").withColumn(name, F.when(F.col("__path").isNotNull(), "true").otherwise("false")).drop("__path")


def required_literal(pattern: str) -> str:
    """The longest text that every match of the pattern holds, or none if it isn't plain to see: what stands outside groups and
    classes without a quantifier, in a pattern without alternatives at its top level, flags, quotes, and escapes that go on
    after their letter."""
    if re.search(r"\(\?(?![:<=!])|\\[QxuUNpPkc0-9]", pattern):
        return ""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, token, i = pattern[i], None, i + 1
        if c == "\\":
            token, i = pattern[i : i + 1], i + 1
            token = token if token and not token.isalnum() else None
        elif c == "[":
            i += pattern[i : i + 1] == "^"
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] in "[&":  # classes in classes
                    return ""
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return ""
        elif c in "*+?{":
            run = run[:-1]
            i = pattern.find("}", i) + 1 or len(pattern) if c == "{" else i
        elif c not in ".^$|":
            token = c
        if token is not None and depth == 0:
            run += token
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def _with_literals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.assign(__literal=rows["__pattern"].map(required_literal))


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def with_pattern_exists(patterns: DataFrame, assets: DataFrame, pattern: str = "pattern", name: str = "rexists") -> DataFrame:
    """Does any asset match the row's own pattern, whole? An inverted index: of the text that every match of a pattern holds, the
    trigram that the fewest assets have names the assets on which the pattern is tried, by an equijoin. Patterns without such a
    text of three letters are tried on all assets, each on each: keep them few. A null pattern has no match."""
    tried = patterns.select(F.col(pattern).cast("string").alias("__pattern")).where("__pattern IS NOT NULL").distinct()
    tried = checkpointed(tried.mapInPandas(_with_literals, "__pattern string, __literal string"))
    fits = F.expr(r"path rlike concat('(?s)\\A(?:', __pattern, ')\\z')")
    plain = tried.where("char_length(__literal) >= 3").select("__pattern", F.explode(_trigrams(F.col("__literal"))).alias("__gram"))
    grams = assets.where("char_length(path) >= 3").select("path", F.explode(_trigrams(F.col("path"))).alias("__gram"))
    index = grams.join(plain.select("__gram").distinct(), "__gram", "left_semi")
    often = index.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = plain.join(often, "__gram", "left").groupBy("__pattern").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__gram"))
    hit = index.join(rarest, "__gram").where(fits).select("__pattern")
    anywhere = tried.where("char_length(__literal) < 3")
    if anywhere.limit(1).count():
        hit = hit.unionByName(assets.select("path").join(anywhere, fits).select("__pattern"))
    hit = hit.groupBy("__pattern").agg(F.lit(1).alias("__hit"))
    return patterns.join(hit, F.col(pattern) == F.col("__pattern"), "left").withColumn(name, F.when(F.col("__hit").isNotNull(), "true").otherwise("false")).drop("__pattern", "__hit")


def resolve_scoped(*by_precedence: Column) -> Column:
    """First set value: nested, parameter, filter capture, input capture, global, command line, environment."""
    return F.coalesce(*by_precedence)
