"""Progress at most once a second, and new and changed files as listings show them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.manifest import extend_directories, split_path, upsert
from ..sources.store import checkpointed, newest_batch, newest_snapshot, read_manifest, write_manifest


def throttled_progress(samples: DataFrame, series: str = "series", ts: str = "ts", value: str = "value", delay: str | None = None) -> DataFrame:
    """(series, second, n, value): one update per series and second. With ``delay`` the input is a stream and late samples are
    waited for that long; the last second of a series comes when the watermark has passed it, so see ``timed_progress`` for
    streams that may fall silent."""
    stamped = samples.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay is not None:
        stamped = stamped.withWatermark(ts, delay)
    each = stamped.groupBy(series, F.window(ts, "1 second")).agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    return each.select(series, F.col("window.start").alias("second"), "n", "value")


def timed_progress(samples: DataFrame, series: str = "series", ts: str = "ts", value: str = "value", delay_s: int = 1, idle_ms: int = 1000) -> DataFrame:
    """``throttled_progress`` of a stream, by a state for each series: a second comes when a sample is later than its end by
    ``delay_s``, and what is pending, the last second included, when the series has been silent for ``idle_ms``. A sample that
    comes later than both gives its second a further row. Needs a trigger by processing time, since only that has timers."""
    kind = samples.schema[series].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = {s: (n, v) for s, n, v in zip(*state.get, strict=True)} if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            due = sorted(pending)
        else:
            for rows in frames:
                for second, n, v in rows.groupby("second")["value"].agg(["size", "sum"]).itertuples():
                    known = pending.get(second, (0, 0.0))
                    pending[second] = (known[0] + int(n), known[1] + float(v))
            due = sorted(s for s in pending if s + 1 + delay_s <= max(pending))
            left = sorted(pending.keys() - set(due))
            state.update((left, [pending[s][0] for s in left], [pending[s][1] for s in left]))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({series: [key[0]] * len(due), "second": due, "n": [pending[s][0] for s in due], "value": [pending[s][1] for s in due]})

    seconds = samples.select(series, F.unix_seconds(F.col(ts).cast("timestamp")).alias("second"), F.col(value).cast("double").alias("value"))
    out = seconds.groupBy(series).applyInPandasWithState(
        update, f"`{series}` {kind}, second long, n long, value double", "seconds array<long>, counts array<long>, sums array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return out.withColumn("second", F.timestamp_seconds("second"))


LISTING = "path string, size long, mtime timestamp, listed long"


def write_listing(assets: DataFrame, folder: str, number: int) -> None:
    """Adds a listing (path, size, mtime) to ``folder``. ``number`` grows from listing to listing."""
    assets.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("timestamp").alias("mtime"), F.lit(number).cast("long").alias("listed")).write.mode("append").parquet(folder)


def changed_assets(known: DataFrame, listings: DataFrame) -> DataFrame:
    """(path, time, size, came): the state of each path after a batch of listings (LISTING), from that before (path, time in
    microseconds, size, -1 for none). ``came`` has the rows, in the order of listings, whose path is new, whose time is later by
    a second or more than when the path last came out, or whose size is another."""
    places = [F.col("listed"), F.col("mtime").isNull(), F.col("mtime"), F.col("size").isNull(), F.col("size")]
    row = F.struct(*[p.alias(f"p{k}") for k, p in enumerate(places)], F.unix_micros("mtime").alias("time"), F.coalesce("size", F.lit(-1)).alias("bytes"))
    rows = listings.groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    before = known.select("path", "time", "size", F.lit(True).alias("known"))
    one = lambda x: F.struct(x["p4"].alias("size"), x["p2"].alias("mtime"), x["p0"].alias("listed"))

    def step(state: Column, x: Column) -> Column:
        later = F.coalesce(x["time"] >= state["time"] + 1_000_000, F.lit(False))
        comes = ~state["known"] | later | (x["bytes"] != state["size"]) | (state["time"].isNull() != x["time"].isNull())
        after = F.struct(F.lit(True).alias("known"), x["time"].alias("time"), x["bytes"].alias("size"), F.concat(state["came"], F.array(one(x))).alias("came"))
        return F.when(comes, after).otherwise(state)

    none = F.array().cast("array<struct<size: bigint, mtime: timestamp, listed: bigint>>")
    start = F.struct(F.coalesce("known", F.lit(False)).alias("known"), F.col("time"), F.coalesce("size", F.lit(-1).cast("long")).alias("size"), none.alias("came"))
    joined = before.join(rows, "path", "full").withColumn("__start", start)
    state = F.when(F.col("__rows").isNull(), F.col("__start")).otherwise(F.aggregate("__rows", F.col("__start"), step))
    return joined.select("path", state.alias("__state")).select("path", "__state.time", "__state.size", "__state.came")


STATE = "path string, time long, size long, came array<struct<size: bigint, mtime: timestamp, listed: bigint>>"


def incremental_arrivals(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """New and changed files of the listings in ``folder`` since the last run, each once, through ``apply`` (batch, number); a
    batch without any isn't handed on. ``apply`` has to give the same result when a number is repeated, which ``manifest_sink``
    does. The state of all paths lies beside the checkpoint, in two folders that take turns, so a batch that is repeated finds
    that of the batch before; it is joined with each batch and written anew."""

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        slot = lambda n: f"{checkpoint.rstrip('/')}-known/{n % 2}"
        known = session.createDataFrame([], STATE) if number == 0 else session.read.schema(STATE).parquet(slot(number - 1))
        changed_assets(known, batch).write.mode("overwrite").parquet(slot(number))
        came = session.read.schema(STATE).parquet(slot(number)).select("path", F.explode("came").alias("__row")).select("path", "__row.*")
        if came.limit(1).count():
            apply(came, number)

    listings = spark.readStream.schema(LISTING).parquet(folder)
    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest_sink(spark: SparkSession, root: str, flags: int = 0) -> Callable[[DataFrame, int], None]:
    """An ``apply`` that upserts each batch into the manifest at ``root``. The batch's number is stored with the snapshot it
    gives, so a batch that comes again changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = newest_batch(session, root)
        if last is not None and number <= last:
            return
        files = session.createDataFrame([], "dir_id long, file string, size long, last_modified timestamp, flags long")
        directories = session.createDataFrame([], "dir_id long, dir string")
        if newest_snapshot(session, root) is not None:
            files, directories = read_manifest(session, root)
        rows = checkpointed(batch)
        directories = checkpointed(extend_directories(directories, rows))
        dir, file = split_path(F.col("path"))
        new = rows.select(dir.alias("dir"), file.alias("file"), "size", F.col("mtime").alias("last_modified"), F.lit(flags).cast("long").alias("flags"), F.col("listed").alias("seq"))
        write_manifest(upsert(files, new.join(directories, "dir")), directories, root, number)

    return apply
