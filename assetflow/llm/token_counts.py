"""Token counts by an exact histogram of encoded lengths.

Whole texts are encoded where they are read, and only (length, documents) pairs leave a task. Everything asked about
context limits afterwards is read from the histogram's suffix sums: how many documents are longer than a limit, how many
tokens they have, and what a corpus truncated at the limit holds. The vocabulary's path is a parameter.

Scale: the shuffle carries one row per task chunk and distinct length. Suffix sums are taken in two levels, blocks of
1,024 lengths and lengths within a block, so no task holds all lengths.

Defined results: null and empty texts have 0 tokens and are counted; strings of special tokens are ordinary text; texts of
any length are encoded whole (long runs of blanks, on which the encoder's pattern fails, are cut out as the pieces that the
pattern makes of them); repeated rows count each, and documents of equal length are one row of the histogram; an empty table
gives an empty histogram; other columns of ``docs``, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, to_python

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that parts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024
#: Runs of this many blanks or more don't go through the pattern, whose look-ahead goes back over all of them.
LONG_BLANKS = 4096
#: The characters that the pattern takes for blanks (Unicode's White_Space).
_BLANKS = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANKS},}}")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The encoding of a rank file, once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(encoding, text: str) -> int:
    """Number of tokens of ``text``. A run of blanks is a piece of its own but for its last character, which may belong to
    what follows; at the end of the text it is a piece whole. A text shorter than such a run has none."""
    if len(text) < LONG_BLANKS:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def _counter(path: str, pattern: str, shipped: bool) -> Callable:
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(SparkFiles.get(path) if shipped else path, pattern)
        for batch in batches:
            found = Counter(encoded_length(encoding, t.as_py()) if t.is_valid else 0 for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "docs"])

    return lengths


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length. The rank file is sent to the executors."""
    context = docs.sparkSession.sparkContext
    context.addFile(vocabulary)
    name = vocabulary.rstrip("/").rpartition("/")[2]
    counts = to_python(docs).select(text).mapInArrow(_counter(name, pattern, True), "n_tokens long, docs long")
    return counts.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """Per length: docs; docs_over and tokens_over (documents longer than it, and their tokens); truncated_total (tokens left
    if every document is cut at this length); total_tokens; quantile (share of documents up to it)."""
    h = cut(histogram).withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("__tokens", F.col("n_tokens") * F.col("docs"))
    sums = h.groupBy("__block").agg(F.sum("docs").alias("d"), F.sum("__tokens").alias("t"))
    # One row for each 1,024 lengths.
    after = Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        F.col("__block").alias("__of"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("__d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("__t_after"),
        F.sum("d").over(whole).alias("__docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("__block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = h.join(sums, h["__block"] == sums["__of"])
    over = joined.withColumn("docs_over", F.coalesce(F.sum("docs").over(within), F.lit(0)) + F.col("__d_after")).withColumn(
        "tokens_over", F.coalesce(F.sum("__tokens").over(within), F.lit(0)) + F.col("__t_after")
    )
    return over.select(
        "n_tokens", "docs", "docs_over", "tokens_over",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        "total_tokens", ((F.col("__docs") - F.col("docs_over")) / F.col("__docs")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits (``context_limit``): the answer at the longest length up to
    the limit, with what the longer documents gain by the difference. Lengths and limits are sorted together, by blocks: a
    limit takes the last length before it in its block or, if there is none, the last of the blocks before."""
    facts = F.struct("n_tokens", "docs_over", "truncated_total")
    both = table.select(F.col("n_tokens").alias("at"), facts.alias("b"), F.lit(None).cast("long").alias("context_limit")).unionByName(
        limits.select("context_limit").distinct().where("context_limit IS NOT NULL").select(F.col("context_limit").alias("at"), F.lit(None).cast(table.select(facts.alias("b")).schema["b"].dataType).alias("b"), F.col("context_limit").cast("long").alias("context_limit"))
    )
    both = cut(both.withColumn("block", F.floor(F.col("at") / BLOCK)))
    last = both.groupBy("block").agg(F.max_by("b", F.when(F.col("b").isNotNull(), F.col("at"))).alias("b"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 1,024 lengths
    carried = last.select(F.col("block").alias("of"), F.last("b", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("block").orderBy("at", F.col("context_limit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("own", F.last("b", ignorenulls=True).over(within)).where("context_limit IS NOT NULL").join(carried, F.col("block") == F.col("of"))
    near = near.select("context_limit", F.coalesce("own", "carried").alias("b"))
    n = table.agg(F.sum("docs").alias("__all"))
    over = F.coalesce("b.docs_over", "__all", F.lit(0))
    gain = (F.col("context_limit") - F.coalesce("b.n_tokens", F.lit(0))) * over
    return near.crossJoin(F.broadcast(n)).select("context_limit", over.alias("docs_over"), (F.coalesce("b.truncated_total", F.lit(0)) + gain).alias("truncated_total"))  # one row


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length with at least that share of the documents up to it."""
    return table.agg(*[F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(str(i)) for i, s in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(str(i)).alias("n_tokens")) for i, s in enumerate(shares)])).alias("q")
    ).select("q.*")
