"""Aggregates over assets, transitions and runs. Order always comes from ``ord``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.flags import has_flags
from ..functions.text import escape
from ..schema import EXISTS, MODIFIED, TEMPORARY
from .windows import ranked


def _in_order(value: Column, ord: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(ord.alias("o"), value.alias("v")))), lambda x: x["v"])


def combine_all(path: Column, ord: Column) -> Column:
    """Paths joined by one space in input order; a path that ends in a space gets no second one."""
    return F.regexp_replace(F.array_join(_in_order(path, ord), " \0"), "^\0|(?<= ) \0|\0", "")


def combine_all_quoted(path: Column, ord: Column) -> Column:
    return F.array_join(_in_order(F.concat(F.lit('"'), escape(path), F.lit('"')), ord), " ")


def combined_parts(inputs: DataFrame, by: list[str], part_rows: int = 10_000, path: str = "path", ord: str = "ord", quoted: bool = False) -> DataFrame:
    """(``by``, part, n, inputs): the list of ``combine_all`` in pieces of ``part_rows`` paths, for groups that don't fit one
    value. Pieces joined as paths are, in their order, give the whole. Places come from ranges of the table's order, so no task
    holds a group."""
    placed = ranked(inputs.select(*by, path, ord), [F.col(c) for c in (*by, ord, path)], "__at").withColumn("__start", F.lit(0))
    if by:
        begin = placed.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.min("__at").alias("__start"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by])
        placed = placed.drop("__start").join(begin, same)
    part = F.floor((F.col("__at") - F.col("__start")) / part_rows).cast("long")
    joined = combine_all_quoted if quoted else combine_all
    return placed.groupBy(*by, part.alias("part")).agg(F.count("*").alias("n"), joined(F.col(path), F.col(ord)).alias("inputs"))


def first_input(path: Column, ord: Column) -> Column:
    return F.min_by(path, ord)


def most_recent_change(mtime: Column) -> Column:
    return F.max(mtime)


def oldest_output_change(mtime: Column, flags: Column) -> Column:
    """Over permanent outputs."""
    return F.min(F.when(~has_flags(flags, TEMPORARY), mtime))


def state_rollup(exists_in: Column, exists_out: Column, modified_in: Column, modified_out: Column) -> list[Column]:
    return [
        F.bool_and(exists_in).alias("all_input_exists"), F.bool_and(exists_out).alias("all_output_exists"),
        F.bool_or(modified_in).alias("input_was_modified"), F.bool_or(modified_out).alias("output_will_be_modified"),
    ]


def needs_build(flags: Column) -> Column:
    """An input is modified, or neither exists nor is temporary."""
    return has_flags(flags, MODIFIED) | ~(has_flags(flags, EXISTS) | has_flags(flags, TEMPORARY))


def needs_build_any(flags: Column, mtime: Column) -> Column:
    return F.coalesce(F.bool_or(needs_build(flags) & mtime.isNotNull()), F.lit(False))


def flat_dependent_map(edges: DataFrame) -> DataFrame:
    """(output, dependencies): the distinct dependencies of outputs that are modified or missing, else an empty set.
    ``edges``: output, flags, dependency."""
    due = has_flags(F.col("flags"), MODIFIED) | ~has_flags(F.col("flags"), EXISTS)
    return edges.groupBy("output").agg(F.sort_array(F.collect_set(F.when(due, F.col("dependency")))).alias("dependencies"))


def find_duplicates(paths: DataFrame, scope: str = "process") -> DataFrame:
    """(process, role, path, n) of paths that occur twice among a process's inputs or outputs; ``scope="pipeline"`` looks
    across processes."""
    keys = ["role", "path"] if scope == "pipeline" else ["process", "role", "path"]
    return paths.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reject_duplicates(paths: DataFrame) -> DataFrame:
    """``paths``, or an error that names a duplicate."""
    found = find_duplicates(paths).first()
    if found:
        raise ValueError(f"{found['role']} occurs {found['n']} times in process {found['process']}: {found['path']}")
    return paths


def count_commands(transitions: DataFrame, commands: str = "commands") -> DataFrame:
    """The commands of all transitions; ``commands`` is a transition's list of them or their number."""
    many = F.size(commands) if isinstance(transitions.schema[commands].dataType, ArrayType) else F.col(commands)
    return transitions.agg(F.coalesce(F.sum(many), F.lit(0)).cast("long").alias("n_commands"))


def run_summary(log: DataFrame, process: str = "process") -> DataFrame:
    """Per process: the worst state, commands, failures, missing outputs and whole seconds. ``log``: state, started, ended,
    output_exists."""
    failed = F.count_if(F.col("state") == "FAILED")
    done = F.bool_and(F.col("state") == "FINISHED")
    return log.groupBy(process).agg(
        F.when(failed > 0, "FAILED").when(done, "FINISHED").otherwise("RUNNING").alias("state"), F.count("*").alias("n_commands"), failed.alias("n_failed"),
        F.count_if(~F.col("output_exists")).alias("n_missing_outputs"), F.sum(F.floor(F.unix_seconds("ended") - F.unix_seconds("started"))).cast("long").alias("seconds"),
    )
