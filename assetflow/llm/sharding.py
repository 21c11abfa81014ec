"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) on a ring of 65,536 slots. A document's position is the hash of its
text, so equal texts start at the same point; it belongs to the next virtual node clockwise. Shard capacities add up to
exactly the number of documents and differ by one at most (law ``rows``): keys that a full shard can't take continue
clockwise to the next virtual node of a shard that has room. Adding a shard moves what falls to its virtual nodes and
the overflow, not everything.

Scale: documents are counted by arc (shards x virtual nodes numbers, whatever the number of documents), the overflow is
settled on those counts, and each document finds its place by its rank within its arc. Arcs are cut by the hash of the id
into as many parts as their counts ask for, ``PART_ROWS`` rows each, so that an arc which holds a third of all rows is still
ranked in many tasks. Texts aren't shuffled unless ``keep`` names them.

Defined results: a null text has size 8 and the checksum 0, like an empty one; a text's length doesn't matter; equal rows get
different slots, in an order that is theirs alone; rows of one id and different texts are placed by their texts; null ids are
placed like others; an empty table gives an empty table; columns named like the results are replaced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sent_if_small

VIRTUAL_NODES = 64
#: Rows of an arc that one task ranks, about.
PART_ROWS = 200_000
#: Positions on the ring; a fixed number, so tables of ring slots have a fixed size.
SLOTS = 1 << 16
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(ring slot, shard) in clockwise order; a shard's points don't depend on the number of shards."""
    return sorted((zlib.crc32(f"{s}/{v}".encode()) % SLOTS, s) for s in range(shards) for v in range(virtual_nodes))


def settle(points: list[tuple[int, int]], counts: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """Per arc, (shard, how many of its keys): owners first, in clockwise order; what is left walks on clockwise."""
    room = list(capacity)
    out: list[list[tuple[int, int]]] = []
    left = []
    for (_, s), n in zip(points, counts, strict=True):
        take = min(n, room[s])
        room[s] -= take
        out.append([(s, take)] if take else [])
        left.append(n - take)
    for a, n in enumerate(left):
        step = a
        while n:
            step = (step + 1) % len(points)
            s = points[step][1]
            take = min(n, room[s])
            if take:
                room[s] -= take
                out[a].append((s, take))
                n -= take
    return out


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def arc_of_slot(slots: int, points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(arc, first ring slot, last ring slot): a slot belongs to the first virtual node at or after it, clockwise."""
    out, start, at = [], 0, [p for p, _ in points]
    for a, p in enumerate(at):
        if p >= start:
            out.append((bisect_left(at, p), start, p))
            start = p + 1
    if start < slots:
        out.append((0, start, slots - 1))
    return out


def assign_shards(
    docs: DataFrame,
    shards: int,
    keep: tuple[str, ...] = ("doc_id",),
    id: str = "doc_id",
    text: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The columns ``keep`` with size, text_crc32, law, shard, slot and grown_shard (null under this law). ``docs`` is read
    twice: once for the counts, once to place the documents."""
    spark = docs.sparkSession
    points = ring(shards, virtual_nodes)
    kept = [c for c in keep if c not in MADE]
    arcs = F.broadcast(  # as many rows as the ring has slots, whatever the data
        spark.createDataFrame(arc_of_slot(SLOTS, points), "__arc int, lo int, hi int").select("__arc", F.explode(F.sequence("lo", "hi")).alias("__slot"))
    )
    body = F.coalesce(F.col(text), F.lit(""))
    fine = max(64, -(-docs.count() // part_rows))
    based = (
        docs.select(
            *kept,
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(body), F.lit(SLOTS)).cast("int").alias("__slot"),
            F.xxhash64(F.lit("order"), F.col(id)).alias("__order"),
            F.col(id).alias("__id"),
        )
        .withColumn("__fine", F.pmod("__order", F.lit(fine)))
        .join(arcs, "__slot")
        .drop("__slot")
    )
    counts = cut(based.groupBy("__arc", "__fine").agg(F.count("*").alias("__n")))
    by_arc = dict(counts.groupBy("__arc").agg(F.sum("__n")).collect())  # one number for each arc of the ring
    settled = settle(points, [by_arc.get(a, 0) for a in range(len(points))], capacities(sum(by_arc.values()), shards))
    filled = [0] * shards
    plan = []
    for a, parts in enumerate(settled):
        rank = 0
        for s, n in parts:
            plan.append((a, s, rank, rank + n, filled[s] - rank))
            rank, filled[s] = rank + n, filled[s] + n
    plan = F.broadcast(spark.createDataFrame(plan, "__arc int, shard int, __from long, __to long, __shift long"))
    # An arc's parts: runs of its fine buckets. One row for each arc, and one for each part, of which there are as many as
    # the rows ask for.
    split = F.broadcast(spark.createDataFrame([(a, max(1, -(-n // part_rows))) for a, n in by_arc.items()], "__arc int, __parts long"))
    part = F.floor(F.col("__fine") * F.col("__parts") / F.lit(fine)).cast("long")
    before = Window.partitionBy("__arc").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.join(split, "__arc").groupBy("__arc", part.alias("__part")).agg(F.sum("__n").alias("__n"))
    offsets = sent_if_small(cut(sized.select("__arc", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))))
    within = Window.partitionBy("__arc", "__part").orderBy("__order", "__id", "text_crc32", "size")
    dealt = based.join(split, "__arc").withColumn("__part", part)
    ranked = dealt.withColumn("__rank", F.row_number().over(within).cast("long") - 1).join(offsets, ["__arc", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(plan, (ranked["__arc"] == plan["__arc"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return placed.select(
        *[F.col(c) for c in kept], "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("__rank") + F.col("__shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
