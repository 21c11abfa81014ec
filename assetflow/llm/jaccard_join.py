"""Exact n-gram Jaccard join in metric space.

A document's set is its distinct 5-word shingles, told apart by keyed 64-bit hashes. Jaccard distance is a metric, so:

1. *Pivots and regions.* Shingles are ordered from rare to common by the number of different sets that hold them. Two
   sets at distance 0.25 or less must share one of the rarest ``n - ceil(0.75 n) + 1`` shingles of each. All sets that
   hold a shingle there are neighbours of the smallest of them, their pivot; a pivot's region is the union over its
   shingles. Sets that share nothing fall out here, most documents among them: they are at distance 1 from every pivot, so
   distances alone would leave them all in one region.
2. *Cells, links and windows.* A region of more than ``REGION_SETS`` sets gets sub-pivots, and each set its exact distance to
   each. Sets within 0.25 of a sub-pivot are linked to it at once. The nearest sub-pivot's Voronoi cell takes the set; a set
   ``y`` of another cell is replicated to that of ``q`` when ``d(y, q) <= radius(q) + 0.25``, the triangle inequality's bound
   for a link into it. Cells whose sets are connected already need no comparison and are left out; cells that are too large
   are split again. Where windows would replicate everything (a dense group of near copies), the region stays whole for
   another round of sub-pivots, taken from the sets that aren't in its largest component yet.
3. *Exact join.* Within a region or cell, overlaps are counted on posting lists and linked sets are united at once, from the
   components known so far; only a spanning forest of links leaves the task, never all pairs of a group.

A region that is still too large after four rounds, or sooner where rounds don't unite it, is joined in blocks: the sets outside its largest component with all of
its sets. If its sets are close to each other without being linked, that is most of them, at a cost that grows with the
square of their number; no bound of a metric can tell such sets apart.

Equal sets are one class before anything is joined. Components of the links are built by star contraction.

Scale: shingles travel as packed arrays in blocks by shingle hash, once; what comes back and what is joined are the
shingles that two or more different sets share. A chunk of text sends a set or a hot shingle once, whatever its number of
holders there: holders of hot shingles go by set, so no task gathers all that hold one.

Defined results: null and empty texts have no shingles and link with nothing; texts of any length are taken whole; a
document's component is the smallest id reachable, itself included; equal rows get equal results; rows of one id with
different texts are documents of their own; a null id joins nothing and has a null component; an empty table gives an empty
table; other columns of ``docs``, whatever their names, are neither read nor returned.

The hashes are keyed anew in each call, so no text can be made to collide; results don't depend on the key. Seven bytes of a
shingle's hash are sent with the number of its bucket, which is of the high bits and of which there is one for each million
shingles: n shingles make about n / 10^11 pairs that are taken for equal by chance, up to 256 million; beyond, all 64 bits
count. Sets are named by 64 bits, with about n^2 / 2^65 pairs of the same name among n different sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, Rolling, as_signed, cut, mix, secret, sent_if_small, small, text_chunks, to_python, word_hashes, words
from .components import components

GRAM = 5
#: Percent of the union.
SIMILARITY = 75
RADIUS = 1 - SIMILARITY / 100
BUCKET_SHINGLES = 1_000_000
#: A shingle that so many different sets of one chunk hold is common; its order among common ones is its hash.
HOT_SETS = 32
COMMON = np.iinfo(np.uint16).max
#: A region beyond either limit is split.
REGION_SETS = 1024
REGION_SHINGLES = 2_000_000
CELLS = 16
WORD_BASE = 0xC2B2AE3D27D4EB4F


def shingles(data: np.ndarray, offsets: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) sorted by row and shingle, without repeats."""
    n = len(offsets) - 1
    low = LOWER[data]
    start, end, row = words(low, offsets, BLANKS)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    roll = Rolling(word_hashes(low, start, end, key), WORD_BASE)
    first = np.arange(max(0, len(start) - GRAM + 1))
    first = first[row[first] == row[first + GRAM - 1]]
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < GRAM))
    at = np.searchsorted(row, short)
    rows = np.concatenate([row[first], short])
    hashes = np.concatenate([mix(roll.of(first, first + GRAM)), mix(roll.of(at, at + count[short]) + count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def _sets(batch: pa.RecordBatch, key: int) -> Iterator[tuple]:
    """Chunks of a batch: first row, counts, two digests of each set, and the shingles in order."""
    for first, data, offsets in text_chunks(batch.column(1)):
        n = len(offsets) - 1
        rows, hashes = shingles(data, offsets, key)
        counts = np.bincount(rows, minlength=n)
        ends = np.concatenate([[0], np.cumsum(counts)])
        digests = []
        for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
            digests.append(as_signed(mix(total[ends[1:]] - total[ends[:-1]] + counts.astype(np.uint64))))
        yield first, counts, digests, rows, hashes


def digest_maker(key: int) -> Callable:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, (k1, k2), _, _ in _sets(batch, key):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(counts.astype(np.int64)), pa.array(k1), pa.array(k2)], ["__id", "n", "k1", "k2"])

    return digests


BLOCK = "bucket long, sets binary, counts binary, held binary, shingles binary"
PART = "part long, sets binary, counts binary, held binary, shingles binary, df binary"


#: Bytes of a shingle that are sent.
SENT = 7


def packed(hashes: np.ndarray) -> bytes:
    """The low seven bytes of each. The bucket's number is of the high bits: from 256 buckets on it tells all that is left."""
    return np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def unpacked(raw: np.ndarray, bucket: int | np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // SENT, 8), np.uint8)
    out[:, :SENT] = raw.reshape(-1, SENT)
    return mix(out.view("<u8").ravel() + np.atleast_1d(bucket).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _different(batch: pa.RecordBatch, key: int) -> Iterator[tuple]:
    """Chunks of a batch without the sets that the chunk has before: counts, digests, row and shingle; and which shingles
    many sets of the chunk hold."""
    for _, counts, (k1, _), rows, hashes in _sets(batch, key):
        first = np.zeros(len(k1), bool)
        first[np.unique(k1, return_index=True)[1]] = True
        keep = first[rows]
        rows, hashes = rows[keep], hashes[keep]
        _, inverse, holders = np.unique(hashes, return_inverse=True, return_counts=True)
        yield counts, k1, rows, hashes, (holders >= HOT_SETS)[inverse]


def block_maker(buckets: int, key: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles by bucket with the sets that hold them. Of a shingle that is hot in the chunk only the fact goes there
        (a row without sets); its holders go by ``hot_maker``."""
        for batch in batches:
            for counts, k1, rows, hashes, hot in _different(batch, key):
                bucket = _bucket(hashes, buckets)
                out = []
                for facts in (False, True):
                    own = np.flatnonzero(hot == facts)
                    if facts:
                        own = own[np.unique(hashes[own], return_index=True)[1]]
                    order = own[np.lexsort((rows[own], bucket[own]))]
                    at = _runs(bucket[order])
                    for a, b in zip(at[:-1], at[1:], strict=True):
                        i = order[a:b]
                        cut_at = _runs(rows[i])
                        held = rows[i][cut_at[:-1]]
                        sets = (b"", b"", b"") if facts else (k1[held].tobytes(), counts[held].astype(np.int32).tobytes(), np.diff(cut_at).astype(np.int32).tobytes())
                        out.append((int(bucket[i[0]]), *sets, packed(hashes[i])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["bucket", "sets", "counts", "held", "shingles"])

    return blocks


def hot_maker(buckets: int, parts: int, key: int) -> Callable:
    def hot_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holders of the chunk's hot shingles, straight to the sets' parts: they are common, whatever their number."""
        for batch in batches:
            for counts, k1, rows, hashes, hot in _different(batch, key):
                rows, hashes = rows[hot], hashes[hot]
                ids = unpacked(np.frombuffer(packed(hashes), np.uint8), _bucket(hashes, buckets))
                yield from _by_part(k1[rows], counts[rows].astype(np.int32), ids, np.full(len(ids), COMMON), parts).to_batches()

    return hot_lists


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits: each doubling of the buckets adds a bit to those that are sent."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_part(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, df: np.ndarray, parts: int) -> pa.Table:
    """Rows of PART: a set's key and count stand once for all of its shingles."""
    part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((counts, keys, part))
    at = _runs(part[order])
    out = [[] for _ in range(6)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        i = order[a:b]
        own = np.ones(len(i), bool)
        own[1:] = (keys[i][1:] != keys[i][:-1]) | (counts[i][1:] != counts[i][:-1])
        begin = np.flatnonzero(own)
        held = np.diff(np.concatenate([begin, [len(i)]])).astype(np.int32)
        row = (int(part[i[0]]), keys[i][begin].tobytes(), counts[i][begin].tobytes(), held.tobytes(), hashes[i].tobytes(), np.minimum(df[i], COMMON).astype(np.uint16).tobytes())
        for c, v in zip(out, row, strict=True):
            c.append(v)
    kinds = (pa.int64(), *[pa.binary()] * 5)
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["part", "sets", "counts", "held", "shingles", "df"])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def shared_maker(parts: int) -> Callable:
    def shared(group: pa.Table) -> pa.Table:
        """Of a bucket's shingles those that two or more sets hold, with that number, in blocks by set."""
        bucket = group.column("bucket")[0].as_py()
        facts = pa.compute.equal(pa.compute.binary_length(group.column("sets")), 0)
        hot = np.unique(unpacked(_joined(group.filter(facts).column("shingles"), np.uint8), bucket))
        group = group.filter(pa.compute.invert(facts))
        held = _joined(group.column("held"), np.int32)
        keys = np.repeat(_joined(group.column("sets"), np.int64), held)
        counts = np.repeat(_joined(group.column("counts"), np.int32), held)
        hashes = unpacked(_joined(group.column("shingles"), np.uint8), bucket)
        order = np.lexsort((keys, hashes))
        keys, counts, hashes = keys[order], counts[order], hashes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])
        keys, counts, hashes = keys[fresh], counts[fresh], hashes[fresh]
        at = _runs(hashes)
        df = np.repeat(np.diff(at), np.diff(at))
        df[np.isin(hashes, hot)] = COMMON  # hot in some chunk: common everywhere, so the order is the same for all sets
        more = df > 1
        return _by_part(keys[more], counts[more], hashes[more], df[more], parts)

    return shared


def prefixes(group: pa.Table) -> pa.Table:
    """Per set that may have a neighbour: its shared shingles from rare to common, and those within its prefix."""
    held = _joined(group.column("held"), np.int32)
    keys, counts = (np.repeat(_joined(group.column(c), k), held) for c, k in (("sets", np.int64), ("counts", np.int32)))
    hashes, df = _joined(group.column("shingles"), np.uint64), _joined(group.column("df"), np.uint16)
    order = np.lexsort((hashes, df, counts, keys))
    keys, counts, hashes = keys[order], counts[order], hashes[order]
    fresh = np.ones(len(keys), bool)  # a set that several chunks have comes with its hot shingles from each
    fresh[1:] = (keys[1:] != keys[:-1]) | (counts[1:] != counts[:-1]) | (hashes[1:] != hashes[:-1])
    keys, counts, hashes = keys[fresh], counts[fresh], hashes[fresh]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (counts[1:] != counts[:-1])
    at = np.concatenate([np.flatnonzero(new), [len(keys)]])
    n = counts[at[:-1]].astype(np.int64)
    width = n + (-SIMILARITY * n) // 100 + 1 - (n - np.diff(at))
    out = [[], [], [], []]
    for i in np.flatnonzero(width > 0):
        own = hashes[at[i] : at[i + 1]]
        for c, v in zip(out, (int(keys[at[i]]), int(n[i]), own[: width[i]].view(np.int64).tolist(), own.tobytes()), strict=True):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["set", "n", "prefix", "shingles"])


def forest(n: np.ndarray, sets: list[np.ndarray], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets' exact join. A row of overlaps is counted for every set outside the component
    that is largest when its turn comes, until no set outside it is left uncounted. Sets with equal ``known`` numbers are
    connected from the start."""
    firsts: dict[int, int] = {}
    parent = [firsts.setdefault(c, i) for i, c in enumerate(known if known is not None else range(len(sets)))]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.bincount(parent, minlength=len(sets)).tolist()
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    posted, values = row[order], flat[order]
    links, todo, largest = [], list(range(len(sets) - 1, -1, -1)), int(np.argmax(size))
    skipped: list[int] = []
    while todo or skipped:
        if not todo:
            todo, skipped = [x for x in skipped if find(x) != find(largest)], [x for x in skipped if find(x) == find(largest)]
            if not todo:
                break
        x = todo.pop()
        if find(x) == find(largest) and size[find(x)] > 1:
            skipped.append(x)
            continue
        lo, hi = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        span = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        overlap = np.bincount(posted[at], minlength=len(sets))
        near = np.flatnonzero(100 * overlap >= SIMILARITY * (n[x] + n - overlap))
        for y in near.tolist():
            a, b = find(x), find(y)
            if a != b:
                links.append((x, y))
                if size[a] < size[b]:
                    a, b = b, a
                parent[b] = a
                size[a] += size[b]
                if size[a] > size[find(largest)]:
                    largest = a
    return links


def join_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, set, component known so far, n, shingles) come sorted by region; each region is joined when its last row
    is in."""
    region, keys, known, ns, sets = None, [], [], [], []

    def flush() -> pa.RecordBatch:
        links = forest(np.array(ns, np.int64), sets, known) if len(keys) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in links], pa.int64()), pa.array([keys[b] for _, b in links], pa.int64())], ["a", "b"])

    done: list[pa.RecordBatch] = []
    for batch in batches:
        for r, k, c, n, s in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4), strict=True):
            if r != region:
                if len(keys) > 1:
                    done.append(flush())
                region, keys, known, ns, sets = r, [], [], [], []
            keys.append(k)
            known.append(c)
            ns.append(n)
            sets.append(np.frombuffer(s.as_buffer(), np.uint64))
        yield from done
        done = []
    yield flush()


def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region, salt and kind: a region's sub-pivots, then members; gives each member's distance to each
    sub-pivot, and which of them it is linked to."""
    here, pivots = None, []
    for batch in batches:
        out = []
        for r, salt, kind, k, n, s in zip(*[batch.column(i).to_pylist() for i in range(5)], batch.column(5), strict=True):
            own = np.frombuffer(s.as_buffer(), np.uint64)
            if (r, salt) != here:
                here, pivots = (r, salt), []
            if kind == 0:
                pivots.append((k, n, own))
                continue
            d, near = [], []
            for q, m, p in pivots:
                o = len(np.intersect1d(p, own, assume_unique=True))
                d.append(1 - o / (n + m - o))
                if q != k and 100 * o >= SIMILARITY * (n + m - o):
                    near.append(q)
            out.append((r, k, d, near))
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["region", "set", "d", "near"])


def _sizes(members: DataFrame, sets: DataFrame) -> DataFrame:
    return members.join(sets.select("set", F.size("prefix").alias("p"), (F.length("shingles") / 8).alias("w")), "set").groupBy("region").agg(F.count("*").alias("members"), F.sum("w").alias("weight"))


def _measured(pivots: DataFrame, large: DataFrame, sets: DataFrame, most_sets: int) -> DataFrame:
    """(region, set, d, near, home): distances of all sets of the regions ``large`` (region, set, members) to their sub-pivots
    (region, q, set, members). A region's sets are dealt over tasks, each with the sub-pivots."""
    salts = F.ceil(F.col("members") / most_sets).cast("long")
    with_sets = sets.select("set", "n", "shingles")
    dealt = pivots.join(with_sets, "set").select("region", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "q", "set", "n", "shingles")
    rest = large.join(with_sets, "set").select("region", F.pmod(F.xxhash64("set"), salts).alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("q"), "set", "n", "shingles")
    return cut(
        dealt.unionByName(rest).repartition("region", "salt").sortWithinPartitions("region", "salt", "kind", "q")
        .select("region", "salt", "kind", "set", "n", "shingles").mapInArrow(distances, "region long, set long, d array<double>, near array<long>")
        .withColumn("home", F.coalesce(F.array_position("d", F.array_min("d")), F.lit(1)).cast("int"))
    )


def _cells(measured: DataFrame, level: int) -> DataFrame:
    """(parent, region, set): Voronoi cells with the sets that the windows replicate to earlier cells."""
    radius = measured.where(F.size("d") > 0).groupBy("region", "home").agg(F.max(F.expr("d[home - 1]")).alias("r"))
    reach = measured.select("region", "set", "home", F.posexplode("d").alias("i", "di")).where("i + 1 < home").withColumn("i", F.col("i") + 1)
    guests = reach.join(radius.withColumnRenamed("home", "i"), ["region", "i"]).where(F.col("di") <= F.col("r") + F.lit(RADIUS + 1e-9))
    named = lambda df, c: df.select(F.col("region").alias("parent"), F.xxhash64("region", c, F.lit(level)).alias("region"), "set")
    return named(measured, "home").unionByName(named(guests, "i"))


def _blocks(large: DataFrame, most_sets: int, most_shingles: int) -> DataFrame:
    """(region, set): blocks of the sets outside each region's largest component, each with blocks of all its sets. ``large``:
    region, set, known, main, members, outside, weight."""
    width = F.least(F.lit(most_sets / 2), F.lit(most_shingles / 2) * F.col("members") / F.greatest("weight", F.lit(1)))
    dealt = large.withColumn("k", F.ceil(F.col("members") / width).cast("long")).withColumn("m", F.ceil(F.col("outside") / width).cast("long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n, what: F.pmod(F.xxhash64("set", F.lit(what)), F.col(n))
    everything = dealt.select("region", "set", own("k", "all").alias("i"), upto(F.col("m")).alias("j"))
    outside = dealt.where("known <> main").select("region", "set", own("m", "out").alias("j"), upto(F.col("k")).alias("i"))
    return everything.unionByName(outside).select(F.xxhash64("region", "i", "j", F.lit("block")).alias("region"), "set").distinct()


def split_regions(members: DataFrame, sets: DataFrame, most_sets: int, most_shingles: int, cells: int = CELLS, rounds: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """((region, set, known) with every region within the limits, links found on the way). ``known`` is the set's component by
    the links so far."""
    done: list[DataFrame] = []
    links = labels = whole = None
    labelled = lambda df: df.withColumn("known", F.col("set")) if labels is None else df.join(labels, "set", "left").withColumn("known", F.coalesce("known", "set"))
    for level in range(rounds + 1):
        sized = cut(_sizes(members, sets))
        large = sized.where((F.col("members") > most_sets) | (F.col("weight") > most_shingles))
        rows = large.agg(F.sum("members")).first()[0]
        if not rows:
            done.append(members)
            break
        done.append(members.join(large, "region", "left_anti"))
        mine = labelled(members.join(large, "region"))
        main = mine.groupBy("region", "known").agg(F.count("*").alias("k")).groupBy("region").agg(F.max_by("known", F.struct("k", "known")).alias("main"), F.max("k").alias("k"))
        mine = small(mine.join(main, "region").withColumn("outside", F.col("members") - F.col("k")).drop("k").where("outside > 0"), rows)
        # A region that a round has left whole gets another one only if its links unite it and much is left outside: few sets
        # are cheap to compare with all, and where half of them stay outside, further sub-pivots won't help either.
        through = (F.col("outside") <= most_sets) | (2 * F.col("outside") > F.col("members"))
        stuck = mine if level == rounds else mine.join(whole, "region", "left_semi").where(through) if whole is not None else None
        if stuck is not None:
            done.append(_blocks(stuck, most_sets, most_shingles))
            mine = mine.join(stuck.select("region").distinct(), "region", "left_anti")
            if not mine.limit(1).count():
                break
        # Sub-pivots: the first of a thinned, seeded order, so the ranking sees about 8 x cells rows of a region.
        rank = F.pmod(F.xxhash64("set", F.lit(level)), F.lit(1 << 30))
        thin = mine.where("known <> main").withColumn("rank", rank).where(F.col("rank") <= F.lit(8.0 * cells * (1 << 30)) / F.col("outside"))
        by = Window.partitionBy("region").orderBy("rank", "set")
        pivots = thin.withColumn("q", F.row_number().over(by) - 1).where(F.col("q") < cells).select("region", "q", "set", "members")
        measured = _measured(pivots, mine, sets, most_sets)
        stars = measured.select(F.col("set").alias("a"), F.explode("near").alias("b"))
        links = small(stars if links is None else links.unionByName(stars), cells * rows)
        labels = cut(components(links).select(F.col("node").alias("set"), F.col("component").alias("known")))
        dealt = small(_cells(measured, level), cells * rows)
        # Cells are taken where the windows replicate little; elsewhere the region stays for other sub-pivots.
        parted = dealt.groupBy("parent").agg(F.count("*").alias("rows")).join(sized.select(F.col("region").alias("parent"), "members"), "parent").where("rows <= 2 * members").select("parent")
        inside = labelled(dealt.join(parted, "parent", "left_semi").select("region", "set"))
        open_ = inside.groupBy("region").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("region")
        whole = mine.join(parted, F.col("region") == F.col("parent"), "left_anti").select("region", "set")
        members = small(inside.join(open_, "region", "left_semi").select("region", "set").unionByName(whole), cells * rows)
        whole = members.join(mine.select("region").distinct(), "region", "left_semi").select("region").distinct()
    return labelled(reduce(DataFrame.unionByName, done)).select("region", "set", "known"), links


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES, bucket_shingles: int = BUCKET_SHINGLES
) -> DataFrame:
    """(``id``, n_shingles, component_id), one row per row of ``docs``."""
    own, key = to_python(docs).select(F.col(id).alias("__id"), F.col(text).alias("__text")), secret()
    kind = own.schema["__id"].dataType.simpleString()
    made = cut(own.mapInArrow(digest_maker(key), f"__id {kind}, n long, k1 long, k2 long"))
    classes = cut(made.where("n > 0 AND __id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("__id").alias("rep")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // bucket_shingles))
    parts, named = max(8, buckets // 2), own.where("__id IS NOT NULL")
    shared = named.mapInArrow(block_maker(buckets, key), BLOCK).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_maker(parts), PART)
    shared = shared.unionByName(named.mapInArrow(hot_maker(buckets, parts, key), PART))
    sets = cut(shared.repartition(parts, "part").groupBy("part").applyInArrow(prefixes, "set long, n long, prefix array<long>, shingles binary"))
    held = sets.select("set", F.explode("prefix").alias("shingle"))
    pivots = cut(held.groupBy("shingle").agg(F.min("set").alias("region"), F.max("set").alias("last")).where("region <> last").select("shingle", "region"))
    members = cut(held.join(pivots, "shingle").select("region", "set").distinct())
    members, stars = split_regions(members, sets, region_sets, region_shingles)
    links = (
        members.join(sets.select("set", "n", "shingles"), "set").select("region", "set", "known", "n", "shingles")
        .repartition("region").sortWithinPartitions("region", "set").mapInArrow(join_regions, "a long, b long")
    )
    found = components(links if stars is None else links.unionByName(stars))
    # Components are of sets; each is named by the smallest id of its documents.
    walked = cut(classes.join(found, F.col("k1") == F.col("node"), "left").select("k1", "k2", "n", "rep", F.coalesce("component", "k1").alias("component")))
    names = walked.groupBy("component").agg(F.min("rep").alias("name"))
    labelled = walked.join(names, "component").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n").alias("cn"), "name")
    return (
        made.join(labelled, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
        .select(F.col("__id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("__id").isNotNull(), F.coalesce("name", "__id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, whatever its columns are called: that with the smallest id (null last) and, of
    rows with that id, the smallest text checksum. Rows are told apart by id and checksum, so different texts under one id
    are judged each, and rows without an id take part. Documents without words stay."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = lambda c: f"__c{names.index(c)}"
    who = F.struct(F.col(own(id)).isNull().alias("nameless"), F.col(own(id)).alias("name"), F.xxhash64(own(text)).alias("check"))
    found = cut(jaccard_components(plain.select(who.alias("__who"), F.col(own(text)).alias("__body")), "__who", "__body"))
    gone = cut(found.where(F.col("component_id") < F.col("__who")).select(F.col("__who").alias("__gone")).distinct())
    marked = plain.withColumn("__who", who)
    left = marked.join(sent_if_small(gone), F.col("__who") == F.col("__gone"), "left_anti")
    again = cut(found.where((F.col("component_id") == F.col("__who")) & (F.col("n_shingles") > 0)).groupBy(F.col("__who").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"))
    if not again.limit(1).count():
        return left.select(*plain.columns).toDF(*names)
    repeated = left.join(sent_if_small(again), F.col("__who") == F.col("__again"), "left")
    # Rows of one id and text: the smallest by a hash of all columns, reduced before the shuffle.
    order = F.xxhash64(*[c for c, k in plain.dtypes if "map<" not in k])
    some = repeated.where("__again IS NOT NULL").groupBy("__who").agg(F.min_by(F.struct(*plain.columns), order).alias("row")).select("row.*")
    return repeated.where("__again IS NULL").select(*plain.columns).unionByName(some).toDF(*names)
