"""Blocks turn input assets into transitions and outputs: one per row, one over all, or one without inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.template import Template
from ..schema import FORCED
from .aggregates import combine_all, combine_all_quoted, first_input, needs_build_any
from .predicates import filter_match, filter_not_match, named_captures, overlay
from .windows import ranked


def _outputs(destinations: Mapping[str, str], scope: Mapping[str, Column], temporary: frozenset[str]) -> Column:
    """One struct for each destination, in the order of their names."""
    rows = []
    for i, name in enumerate(sorted(destinations)):
        t = Template(destinations[name])
        rows.append(F.struct(F.lit(i).alias("out_ord"), t.render(scope).alias("output"), t.captures(scope).alias("captures"), F.lit(2 if name in temporary else 0).cast("long").alias("flags")))
    return F.array(*rows)


def select_inputs(assets: DataFrame, pattern: str = ".*", invert: bool = False) -> DataFrame:
    """The block's filter; its named groups overwrite captures of the same name."""
    if invert:
        return filter_not_match(assets, pattern)
    kept = filter_match(assets, pattern)
    return kept.withColumn("captures", overlay(F.col("captures"), named_captures(F.col("path"), pattern)))


def foreach(assets: DataFrame, destinations: Mapping[str, str], names: tuple[str, ...] = (), scope: Mapping[str, Column] | None = None, temporary: frozenset[str] = frozenset()) -> DataFrame:
    """(transition_id, dependency, out_ord, output, captures, flags): one transition per input. ``names`` are the captures
    that templates may use; ``?`` is the input, numbers are positional captures."""
    values = {"?": F.col("path"), **{n: F.col("captures")[n] for n in names}, **(scope or {})}
    return assets.select(F.col("ord").alias("transition_id"), F.col("path").alias("dependency"), F.explode(_outputs(destinations, values, temporary)).alias("o")).select("transition_id", "dependency", "o.*")


def all_of(assets: DataFrame, destinations: Mapping[str, str], by: list[str] | None = None, names: tuple[str, ...] = (), scope: Mapping[str, Column] | None = None) -> DataFrame:
    """One transition over all inputs (of a group ``by``): first input, inputs joined plain and quoted, newest change, verdict
    and outputs, which are rendered from the first input."""
    by = by or []
    path, ord = F.col("path"), F.col("ord")
    one = assets.groupBy(*by).agg(
        F.min("ord").alias("transition_id"), first_input(path, ord).alias("first"), F.min_by("captures", "ord").alias("__captures"), combine_all(path, ord).alias("inputs"),
        combine_all_quoted(path, ord).alias("quoted_inputs"), F.max("mtime").alias("in_mtime"), needs_build_any(F.col("flags"), F.col("mtime")).alias("any_build"), F.count("*").alias("n_inputs"),
    ).where("n_inputs > 0")
    values = {"?": F.col("first"), "*": F.col("inputs"), "@*": F.col("quoted_inputs"), **{n: F.col("__captures")[n] for n in names}, **(scope or {})}
    return one.withColumn("o", F.explode(_outputs(destinations, values, frozenset()))).select("*", "o.*").drop("o", "__captures")


def none(spark: SparkSession, destinations: Mapping[str, str], scope: Mapping[str, Column] | None = None) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("transition_id"), F.explode(_outputs(destinations, scope or {}, frozenset())).alias("o")).select("transition_id", "o.*")


def forward(assets: DataFrame) -> DataFrame:
    """The input passed through as its own output, captures included."""
    return assets


def as_inputs(outputs: DataFrame, mtime: Column | None = None) -> DataFrame:
    """Outputs as the next block's inputs: same captures and flags, and their places in the order of transitions and, in each,
    of its outputs. Places are ranks from 0, so neither many outputs nor long chains make them clash or overflow."""
    time = (mtime if mtime is not None else F.lit(None).cast("timestamp")).alias("mtime")
    rows = outputs.select(F.col("output").alias("path"), "transition_id", "out_ord", time, "flags", "captures")
    return ranked(rows, [F.col("transition_id"), F.col("out_ord"), F.col("path")], "ord").select("path", "ord", "mtime", "flags", "captures")


Block = Callable[[DataFrame], DataFrame]


def then(*blocks: Block) -> Block:
    """Outputs of each block are inputs of the next."""

    def run(df: DataFrame) -> DataFrame:
        for b in blocks:
            df = df.transform(b)
        return df

    return run


def also(*blocks: Block) -> Block:
    """Blocks side by side on the same input; their outputs are put together. Where these have places (``ord``), those of a
    block come after those of the block before."""

    def run(df: DataFrame) -> DataFrame:
        made = [b(df) for b in blocks]
        if len(made) == 1 or "ord" not in made[0].columns:
            return reduce(DataFrame.unionByName, made)
        out = reduce(DataFrame.unionByName, [d.withColumn("__block", F.lit(i)) for i, d in enumerate(made)])
        return ranked(out.withColumnRenamed("ord", "__ord"), [F.col("__block"), F.col("__ord")], "ord").select(*made[0].columns)

    return run


def include_blocks(own: str, processes: Mapping[str, list[Block]], included: list[str]) -> Block:
    """A process made of other processes' blocks."""
    if own in included:
        raise ValueError(f"process {own} includes itself")
    return also(*[b for p in included for b in processes[p]])


def force(outputs: DataFrame) -> DataFrame:
    return outputs.withColumn("flags", F.col("flags").bitwiseOR(F.lit(FORCED)))
