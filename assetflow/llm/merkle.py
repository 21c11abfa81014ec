"""A Merkle manifest of a dataset: one root for all rows, and for each row the proof that it is under it.

A row's leaf is a digest of its fields. The leaves of a source, in the order of their ids, form a tree, whose root is the
subroot; the subroots, in the order of their sources, form the last tree. In every tree ``fanout`` neighbours have one parent.

Levels by sibling shift: a node knows its place, so it can compute those of its siblings (XOR for two, slot offsets
otherwise), and one equijoin of the level with itself for each of the ``fanout`` - 1 shifts brings their digests. The node's
siblings are its part of the proof; the nodes in slot zero, which have all their siblings, emit the parents. From the level that
has ``UPPER_NODES`` nodes at most, one task goes on by the same shifts. Proofs are put together from the top: a node's is its
own siblings and then its parent's proof.

Scale: texts are digested where they lie; what is shuffled are places and 32-byte digests. Places come from ranges, so no task
sorts a source. All sources climb in the same rounds, as many as the logarithm of the largest source; each level is a recovery
point a ``fanout``-th the size of the one before. Joins are on single nodes, which no source makes hot. Only the number of
rows, the largest source's and the root come to the driver.

Defined results: a null field is ``-``, other than an empty one; texts of any length are digested whole; rows are ordered by id
(null first), then by leaf, so rows in another order or partition give the same root; repeated rows are leaves each; a null source is the first source; a lone leaf
is its source's subroot and a lone subroot the root, with an empty proof; an empty table gives no rows; columns that aren't
among the fields, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import PARTITION_ROWS, cut, kept_table, sent_if_small, small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Nodes of a level from which one task climbs to the roots; larger levels are joined with themselves.
UPPER_NODES = 50_000


def digest(*parts: Column) -> Column:
    """SHA-256, as bytes, of digests given as bytes and hashed as lowercase hex text, one after the other."""
    return F.unhex(F.sha2(hex_text(F.concat(*parts)), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row, as bytes: each field by its length in UTF-8 and its value, so that no two rows read alike."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*each), 256))


def _shifted(level: DataFrame, fanout: int) -> DataFrame:
    """Nodes with their siblings to the left and to the right, in order, as bytes."""
    slot, joined, none = F.col("idx") % fanout, level, F.unhex(F.lit(""))
    level = level.hint("merge")  # sorted and merged: what a level would broadcast grows with the table
    for s in range(1, fanout):
        place = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + (slot + s) % fanout
        other = level.select(F.col("tree").alias(f"__t{s}"), F.col("idx").alias(f"__i{s}"), F.col("h").alias(f"__h{s}"))
        joined = joined.join(other, (F.col("tree") == F.col(f"__t{s}")) & (place == F.col(f"__i{s}")), "left")
    # A shift that goes over the run's end comes to the siblings on the left.
    side = lambda wraps: F.concat(none, *[F.when((slot + s >= fanout) == F.lit(wraps), F.coalesce(F.col(f"__h{s}"), none)).otherwise(none) for s in range(1, fanout)])
    return joined.select("tree", "idx", "n", "h", side(True).alias("left"), side(False).alias("right"))


NODES = "tree long, idx long, n long, h binary"
PROOFS = "tree long, idx long, path array<struct<left: binary, right: binary>>, root binary"
_STEPS = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _siblings(i: int, n: int, fanout: int) -> tuple[list[int], list[int]]:
    """Places of node i's siblings on both sides, of n nodes, by shifts of its slot."""
    slot = i % fanout
    places = sorted(i - slot + (slot + s) % fanout for s in range(1, fanout))
    return [p for p in places if p < i], [p for p in places if i < p < n]


def tree_finisher(fanout: int) -> Callable:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The levels above the nodes of NODES, which are UPPER_NODES at most and whole trees: each node's proof and root."""
        rows = sorted(r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("tree", "idx", "h")], strict=True))
        for tree, own in groupby(rows, key=lambda r: r[0]):
            level = [h for _, _, h in own]
            steps: list[list[dict]] = []
            size = len(level)
            while len(level) > 1:
                sides = [_siblings(i, len(level), fanout) for i in range(len(level))]
                steps.append([{"left": b"".join([level[p] for p in a]), "right": b"".join([level[p] for p in b])} for a, b in sides])
                whole = [level[i] + steps[-1][i]["right"] for i in range(0, len(level), fanout)]
                level = [hashlib.sha256(x.hex().encode()).digest() for x in whole]
            for at in range(0, size, 5000):
                some = range(at, min(at + 5000, size))
                paths = [[step[i // fanout**k] for k, step in enumerate(steps)] for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(paths, _STEPS), pa.array([level[0]] * len(some), pa.binary())], ["tree", "idx", "path", "root"]
                )

    return finish


def climb(nodes: DataFrame, rows: int, most: int, fanout: int = FANOUT, upper_nodes: int | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Levels (tree, idx, left, right) from the leaves up; the proofs of the level above them (rows of PROOFS), from which one task
    finishes all trees; and the trees' roots (tree, h). ``nodes`` are rows of NODES with places from 0 and n as their tree's
    number of nodes; ``rows`` is their number, ``most`` the largest n."""
    upper_nodes = UPPER_NODES if upper_nodes is None else upper_nodes
    levels, roots = [], nodes.where("n = 1").select("tree", "h")
    while most > 1 and rows > upper_nodes:
        level = small(_shifted(nodes.where("n > 1"), fanout), rows)
        levels.append(level.select("tree", "idx", "left", "right"))
        first = level.where(F.col("idx") % fanout == 0)
        nodes = first.select("tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(F.col("left"), F.col("h"), F.col("right")).alias("h"))
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "h"))
        most = -(-most // fanout)
        rows = nodes.count()
    upper = cut(nodes.where("n > 1").select("tree", "idx", "n", "h").coalesce(1).mapInArrow(tree_finisher(fanout), PROOFS))
    return levels, upper, cut(roots.unionByName(upper.where("idx = 0").select("tree", F.col("root").alias("h"))))


def proofs(levels: list[DataFrame], upper: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, idx, path) of the lowest level's nodes: siblings on both sides, level by level up to the root."""
    above = upper.select("tree", "idx", "path")
    for level in reversed(levels):
        step = F.array(F.struct("left", "right"))
        up = above.hint("merge").select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("path").alias("__path"))
        joined = level.join(up, (F.col("tree") == F.col("__tree")) & (F.expr(f"idx div {fanout}") == F.col("__idx")), "left")
        above = joined.select("tree", "idx", F.when(F.col("__path").isNull(), step).otherwise(F.concat(step, "__path")).alias("path"))
    return above


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and its proof give, as bytes."""
    return F.aggregate(path, own, lambda h, x: digest(x["left"], h, x["right"]))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a proof, as lowercase hex."""
    return F.sha2(hex_text(F.aggregate(path, F.unhex(F.lit("")), lambda all_, x: F.concat(all_, x["left"], x["right"]))), 256)


def _with_proof(df: DataFrame, found: DataFrame, tree: str, idx: str, name: str) -> DataFrame:
    found = found.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("path").alias(name))
    joined = df.join(found, (F.col(tree) == F.col("__tree")) & (F.col(idx) == F.col("__idx")), "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<struct<left: binary, right: binary>>"))).drop("__tree", "__idx")


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id: str = "doc_id", source: str = "source", altered: Mapping[str, Column] | None = None, fanout: int = FANOUT, upper_nodes: int | None = None) -> DataFrame:
    """(``id``, leaf, altered_leaf, path, subroot, root) per row, digests as bytes; ``path`` is the proof from the leaf to the
    root. ``altered`` replaces fields by changed ones, whose leaf is altered_leaf: what a check against the proof would be given."""
    changed = altered or {}
    leaves = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), leaf([F.col(c) for c in fields]).alias("leaf"), leaf([changed.get(c, F.col(c)) for c in fields]).alias("altered_leaf"))
    # The altered leaf is kept only where it differs.
    leaves = kept_table(leaves.withColumn("altered_leaf", F.when(F.col("altered_leaf") != F.col("leaf"), F.col("altered_leaf"))))
    placed = ranked(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.asc("leaf")], "place")
    sources = cut(placed.groupBy("source").agg(F.count("*").alias("n"), F.min("place").alias("start")))
    n_sources, most, rows = sources.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    by_name = [F.asc_nulls_first("source")]
    if n_sources <= PARTITION_ROWS:
        sources = sources.coalesce(1).withColumn("tree", F.row_number().over(Window.orderBy(*by_name)).cast("long") - 1)
    else:
        sources = cut(ranked(sources, by_name, "tree"))
    sources = sources.withColumnRenamed("source", "__source")
    if not rows:
        return placed.select(F.col("id").alias(id), "leaf", "altered_leaf", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))
    own = placed.join(sources, F.col("source").eqNullSafe(F.col("__source"))).select("id", "leaf", "altered_leaf", "tree", (F.col("place") - F.col("start")).alias("idx"), "n")
    own = cut(own)
    levels, upper, subroots = climb(own.select("tree", "idx", "n", F.col("leaf").alias("h")), rows, most, fanout, upper_nodes)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_sources).cast("long").alias("n"), "h")
    top_levels, top_upper, roots = climb(tops, n_sources, n_sources, fanout, upper_nodes)
    ((root,),) = roots.select("h").collect()  # one row
    above = _with_proof(subroots.select(F.col("tree").alias("__of"), F.col("h").alias("subroot"), F.lit(0).cast("long").alias("__top")), proofs(top_levels, top_upper, fanout), "__top", "__of", "above").drop("__top")
    placed = own.join(sent_if_small(cut(above)), F.col("tree") == F.col("__of"))
    proven = _with_proof(placed, proofs(levels, upper, fanout), "tree", "idx", "path")
    return proven.select(F.col("id").alias(id), "leaf", "altered_leaf", F.concat("path", "above").alias("path"), "subroot", F.lit(bytes(root)).alias("root"))


def verified(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """(``id``, leaf, subroot, root, proof_sha256, folded_root, verified), digests as lowercase hex: each row's altered leaf, or
    its own where nothing was altered, folded with the original siblings, and whether that gives the root."""
    fold = folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    hexed = manifest.select(id, *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("path")).alias("proof_sha256"), hex_text(fold).alias("folded_root"))
    return hexed.withColumn("verified", F.col("folded_root") == F.col("root"))
