"""Frames over progress samples, manifest versions and ordered commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed


def with_progress(df: DataFrame, history: int = 3, series: str = "series", ts: str = "ts", value: str = "value", total: str = "total", tie: str = "event_id") -> DataFrame:
    """current, recent_speed, global_speed, eta_ms and percent after each sample of a series.

    The recent speed is what the last ``history`` samples add, the first of them left out, over the time they span; with a
    single sample it is measured from the start, which is the series' first time. Samples that ``ts`` and ``tie`` don't tell
    apart count together: each of them has the sum that is reached after all."""
    w = Window.partitionBy(series).orderBy(ts, tie)
    so_far = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("current", F.sum(value).over(so_far)).withColumn("__start", F.first(ts).over(so_far))
    return _speeds(out, w.rowsBetween(-(history - 1), 0), ts, value, total)


def _speeds(out: DataFrame, recent: Window, ts: str, value: str, total: str) -> DataFrame:
    """What follows from current, the series' start (``__start``) and the frame of recent samples."""
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    many = F.count("*").over(recent) > 1
    moved = F.when(many, F.sum(value).over(recent) - F.first(value).over(recent)).otherwise(F.col(value))
    since = F.when(many, F.first(ts).over(recent)).otherwise(F.col("__start"))
    out = out.withColumn("__moved", moved).withColumn("__ms", millis(F.col(ts)) - millis(since)).withColumn("__all_ms", millis(F.col(ts)) - millis(F.col("__start")))
    current, whole = F.col("current"), F.col(total)
    unknown = whole.isNull() | (whole == 0) | (current == 0)
    done = current == whole
    endless = F.lit(float("inf"))
    out = out.withColumn("recent_speed", F.when(unknown, None).when(done, 0.0).when((F.col("__ms") <= 0) | (F.col("__moved") <= 0), endless).otherwise(F.col("__moved") / (F.col("__ms") / 1000.0)))
    out = out.withColumn("global_speed", F.when(unknown, None).when(done, 0.0).when(F.col("__all_ms") <= 0, endless).otherwise(current / (F.col("__all_ms") / 1000.0)))
    out = out.withColumn("eta_ms", eta_ms(whole - current, F.col("recent_speed"), done))
    return out.withColumn("percent", progress_percent(current, whole)).drop("__start", "__moved", "__ms", "__all_ms")


def with_progress_by_ranges(df: DataFrame, history: int = 3, series: str = "series", ts: str = "ts", value: str = "value", total: str = "total", tie: str = "event_id") -> DataFrame:
    """``with_progress`` for series that don't fit one task. The samples are dealt by ranges of series and time; each range adds
    up its own, from the sums and the start that the ranges before it carry over, and begins with a halo: the last
    ``history`` - 1 samples of its first series before it. What is carried is a row for each range and series. Samples that tie
    are in one range, so their sum is complete there."""
    dealt = checkpointed(df.repartitionByRange(F.col(series), F.col(ts), F.col(tie)).withColumn("__range", F.spark_partition_id()))
    keep, own = history - 1, ["__range", series]
    last = Window.partitionBy(*own).orderBy(F.desc(ts), F.desc(tie))
    tail = F.array_sort(F.collect_list(F.when(F.col("__back") <= keep, F.struct(ts, tie, value))))
    sums = dealt.withColumn("__back", F.row_number().over(last)).groupBy(*own).agg(F.sum(value).alias("__sum"), F.min(ts).alias("__first"), tail.alias("__tail"))
    ranges = Window.partitionBy(series).orderBy("__range")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    halo = F.flatten(F.collect_list("__tail").over(ranges.rowsBetween(-max(keep, 1), -1)))
    carried = checkpointed(sums.select(
        F.col("__range").alias("__of"), F.col(series).alias("__series"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"),
        F.min("__first").over(ranges.rowsBetween(Window.unboundedPreceding, 0)).alias("__start"), F.slice(halo, F.greatest(F.size(halo) - keep + 1, F.lit(1)), F.lit(keep)).alias("__halo"),
    ))
    here = lambda d: d.join(carried, (F.col("__range") == F.col("__of")) & F.col(series).eqNullSafe(F.col("__series"))).drop("__of", "__series")
    rows = here(dealt).drop("__halo").withColumn("__own", F.lit(True))
    halos = carried.select(F.col("__of").alias("__range"), F.col("__series").alias(series), F.explode("__halo").alias("__h")).select("__range", series, "__h.*", F.lit(False).alias("__own"))
    w = Window.partitionBy(*own).orderBy(ts, tie)
    out = rows.unionByName(halos, allowMissingColumns=True)
    out = out.withColumn("current", F.col("__carried") + F.sum(F.when(F.col("__own"), F.col(value))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return _speeds(out, w.rowsBetween(-keep, 0), ts, value, total).where("__own").drop("__own", "__range", "__carried").select(*df.columns, "current", "recent_speed", "global_speed", "eta_ms", "percent")


def eta_ms(left: Column, speed: Column, done: Column) -> Column:
    """Milliseconds to go, rounded half up; infinite if nothing moves; null if unknown."""
    return F.when(done, 0.0).when(speed == float("inf"), F.lit(float("inf"))).otherwise(F.floor(1000.0 * left / speed + 0.5).cast("double"))


def progress_percent(current: Column, total: Column) -> Column:
    return F.when(total <= 0, 100.0).otherwise(100.0 * current / total)


def percent_text(percent: Column, decimals: int = 0) -> Column:
    """Width 3 without decimals, 5 with one."""
    return F.format_string("%3.0f" if decimals == 0 else "%5.1f", F.bround(percent, decimals))


def keep_latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key, by the order of ``by``: a maximum by group, so rows are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__row"))
    return newest.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def stop_at_first_failure(commands: DataFrame, order: list[str], transition: str = "transition_id", exit_code: str = "exit_code") -> DataFrame:
    """executed: no command before this one in its transition failed."""
    before = Window.partitionBy(transition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return commands.withColumn("executed", ~F.coalesce(F.bool_or(F.col(exit_code) != 0).over(before), F.lit(False)))


def stop_at_first_failure_by_minimum(commands: DataFrame, order: list[str], transition: str = "transition_id", exit_code: str = "exit_code") -> DataFrame:
    """``stop_at_first_failure`` for transitions with more commands than one task takes: the place of the first failure is a
    minimum, reduced before it is shuffled, and commands are compared with it where the join brings them. Places that tie with
    the first failure count as before it."""
    place = F.struct(*order)
    failed = commands.where(F.coalesce(F.col(exit_code) != 0, F.lit(False))).groupBy(F.col(transition).alias("__of")).agg(F.min(place).alias("__first"))
    joined = commands.join(failed, F.col(transition).eqNullSafe(F.col("__of")), "left")
    return joined.withColumn("executed", F.col("__first").isNull() | (place <= F.col("__first"))).drop("__of", "__first")


def first_reason(reasons: DataFrame, by: str = "transition_id", *more: Column) -> DataFrame:
    """(``by``, reason, all_reasons, and ``more`` aggregates): the bits of the first flagged dependency, else of the first flagged output; and all
    bits. ``reasons``: role (``dependency`` or ``output``), ord, bits; where a row stands for several, bits are those of the
    first flagged one and all_bits those of all."""
    all_bits = F.coalesce("all_bits", "bits") if "all_bits" in reasons.columns else F.col("bits")
    flagged = F.col("bits") != 0
    first = lambda role: F.min_by(F.when(flagged & (F.col("role") == role), F.col("bits")), F.when(flagged & (F.col("role") == role), F.col("ord")))
    return reasons.groupBy(by).agg(F.coalesce(first("dependency"), first("output"), F.lit(0)).alias("reason"), F.bit_or(all_bits).alias("all_reasons"), *more)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of the whole table. Ranges of the order are counted and each is
    ranked by itself, so no task sorts all rows; rows that ``order`` doesn't tell apart share a range."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = dealt.groupBy(F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    starts = F.broadcast(sizes.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy("__range").orderBy(*order)
    placed = dealt.withColumn(name, F.row_number().over(within).cast("long") - 1).join(starts, F.col("__range") == F.col("__of"))
    return placed.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__of", "__n", "__before")
