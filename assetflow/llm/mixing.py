"""Mix sources to target weights by capped water-filling, with built-in functions only.

A budget of words is dealt to the sources by weight; no source gets more than ``max_epochs`` times its own size, and what
is cut off there goes to the others by weight, again and again until no target is above its cap. Each source then takes
every document as often as its whole epochs say, and for the fraction left the documents that come first in a seeded
order of hashes, up to the exact number of words; the document on the border is taken in part.

Scale: the sources are an aggregate, ranked by ranges of names, and each step of the filling is one sum over it. The order
within a source is cut into ``SLICES`` by the leading hash bits; only the slice that holds the border is ranked, so a source
with a third of all rows isn't sorted as a whole. Ids and sizes are shuffled, never texts.

Defined results: a null text has size 0 and takes 0; a text of any length is counted whole; null is a source of its own
(last); rows repeated or with equal ids are mixed each, in the order of their ids, sizes and text checksums; an empty table
gives an empty table; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import cut, sent_if_small

SEED = "mix-1"
SLICES = 4096
MADE = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (weight, source_size) with target. Each round clamps the sources above their cap and spreads what is left
    over the others' weights; sums alone come to the driver."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        s = sources.agg(
            F.sum(F.when(capped, cap)).alias("used"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n")
        ).first()
        if not s["weight"]:
            return sources.withColumn("target", cap)
        raised = (budget - (s["used"] or 0.0)) / s["weight"]
        if level is not None and s["n"] == count:
            return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * F.lit(level)))
        level, count = raised, s["n"] if level is not None else -1


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    share: float,
    max_epochs: float = 2.0,
    keep: tuple[str, ...] = ("doc_id",),
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """The columns ``keep`` with size, source_size, target and taken (words, repeats counted). ``weights``: __source, weight;
    ``share``: the mix's words as a multiple of all words."""
    kept = [c for c in keep if c not in MADE]
    based = docs.select(
        *kept,
        F.col(source).alias("__source"),
        size_of(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary")).alias("__hash"),
        F.col(id).alias("__id"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__crc"),
    ).withColumn("__slice", F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int"))
    if text not in kept:
        based = cut(based)
    slices = cut(based.groupBy("__source", "__slice").agg(F.sum("size").alias("__words")))
    sources = cut(
        slices.groupBy("__source").agg(F.sum("__words").alias("source_size"))
        .join(weights.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
        .drop("__of")
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = fill(sources, share * total, max_epochs)
    # Words beyond the whole epochs, and the slice of the seeded order in which they run out.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("__epochs", epochs).withColumn("__extra", F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        slices.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
        .select(
            F.col("__source").alias("__s"), F.col("__slice").alias("__k"), "source_size", "target", "__epochs",
            F.greatest(F.lit(0), F.least("__words", F.col("__extra") - F.col("__before"))).alias("__left"), "__words",
        )
    )
    known = based.join(sent_if_small(cut(dealt)), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__k")))
    border = (F.col("__left") > 0) & (F.col("__left") < F.col("__words"))
    order = Window.partitionBy("__source", "__slice").orderBy("__hash", "__id", "size", "__crc").rowsBetween(Window.unboundedPreceding, -1)
    whole = known.where(~border).withColumn("__more", F.when(F.col("__left") > 0, F.col("size")).otherwise(F.lit(0)))
    part = known.where(border).withColumn("__more", F.greatest(F.lit(0), F.least("size", F.col("__left") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    return whole.unionByName(part).select(*kept, "size", "source_size", "target", (F.col("__epochs") * F.col("size") + F.col("__more")).cast("long").alias("taken"))


def ranked_weights(docs: DataFrame, cycle: tuple[float, ...], source: str = "source") -> DataFrame:
    """(__source, weight): the weights repeat over the sources in code-point order, null last. The sources' names alone are
    ranked, one row for each source, in ranges."""
    names = docs.groupBy(F.col(source).alias("__source")).agg(F.lit(1).alias("__one"))
    placed = ranked(names, [F.col("__source").asc_nulls_last()], "__at")
    return placed.select("__source", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("__at") % len(cycle) + 1).cast("int")).alias("weight"))


def mixed_documents(docs: DataFrame, cycle: tuple[float, ...], share: float, max_epochs: float = 2.0, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as its taken words come to, rounded to whole documents."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = lambda c: f"__c{names.index(c)}"
    mixed = mix_sources(plain, ranked_weights(plain, cycle, own(source)), share, max_epochs, tuple(plain.columns), own(id), own(text), own(source), seed)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return mixed.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*plain.columns).toDF(*names)
