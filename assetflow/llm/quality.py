"""Quality rules per document and per host, with built-in functions only.

Five counts per document decide its base verdict. The failures are then summed by host; each host's rate is shrunk
towards the mean of all hosts by a beta prior whose strength is fitted to the spread of the hosts' rates (moments), so
that a host with few documents isn't judged on chance. A host whose shrunk rate is above the limit is rejected whole.

Scale: repeats are found inside each row by sorting its own 5-word hashes (64 bits), so no text or word is shuffled; the
counts are summed by host, with partial sums before the shuffle, and the host table is joined back to them.

Defined results: a null text has no words and fails; a null host is a host of its own; documents repeated or with equal ids
are judged each; texts of any length are counted whole; an empty table gives an empty table; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sent_if_small

MIN_WORDS = 10
MAX_REPEATED = 0.20
#: A host with a larger shrunk share of failing documents is rejected.
MAX_HOST_RATE = 0.5
GRAM = 5
BLANK = r"[\x20\x09-\x0D]+"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _window_hashes(words: Column) -> Column:
    """One 64-bit hash for each 5-word window, in order; none if there are fewer than two windows."""
    last = F.size(words) - GRAM
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]))
    return F.when(last > 0, hashes).otherwise(F.array().cast("array<long>"))


def _covered(starts: Column) -> Column:
    """Length of the union of [s, s + 5) over sorted starts."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 2, 1 << 30), F.slice(starts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(GRAM)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(GRAM), lambda acc, g: acc + g)).cast("long")


def with_repeats(docs: DataFrame, words: str) -> DataFrame:
    """``docs`` with n_repeat_words: the words inside 5-word windows that occur twice or more.

    Where all windows differ, which a hash set tells, that is all. Else windows are sorted by hash and each is compared with
    its neighbours; the union of those that have an equal one is measured over their sorted starts. Each step is a column of
    its own, so it is computed once."""
    pair = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.filter("__pairs", lambda p, i: F.coalesce(p["h"] == F.get("__sorted", i - 1), F.lit(False)) | F.coalesce(p["h"] == F.get("__sorted", i + 1), F.lit(False)))
    return (
        docs.withColumn("__h", _window_hashes(F.col(words)))
        .withColumn("__pairs", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(pair)).otherwise(F.array().cast("array<struct<h: long, i: int>>")))
        .withColumn("__sorted", F.transform("__pairs", lambda p: p["h"]))  # not a field access, which would be repeated per element
        .withColumn("__starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
        .withColumn("n_repeat_words", _covered(F.col("__starts")))
        .drop("__h", "__pairs", "__sorted", "__starts")
    )


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.drop(*METRICS)
        .withColumn("__words", words_of(body))
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    )
    return (
        with_repeats(counted, "__words")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * MAX_REPEATED)) * F.col("n_words")))
        .drop("__words", "__lines")
    )


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, failures, the rate shrunk by the fitted prior. ``judged`` has base_failed."""
    hosts = judged.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = cut(hosts)
    rate = F.col("failures") / F.col("docs")
    # One row of moments: the rates' spread beyond what chance gives hosts of these sizes is the prior's variance.
    m = hosts.agg(
        F.count("*").alias("k"), F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.sum(rate * rate * F.col("docs")).alias("q")
    ).first()
    k, n, f, q = m["k"] or 0, m["n"] or 0, m["f"] or 0, m["q"] or 0.0
    mean = f / n if n else 0.0
    between = max(0.0, q - n * mean * mean)
    noise = (k - 1) * mean * (1 - mean)
    spread = (between - noise) / n if n else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
    return hosts.withColumn("shrunk_rate", (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength)))


def judge(docs: DataFrame, keep: tuple[str, ...], text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, host_rate and kept, one row per document. What is kept is checkpointed,
    since two steps read it; so it should be keys rather than texts."""
    cols = tuple(dict.fromkeys(c for c in keep if c not in METRICS and c not in ("kept", "host_rate")))
    rest = [c for c in {text, host} if c not in cols]
    judged = cut(with_metrics(docs.select(*cols, *rest), text).select(*cols, *METRICS, F.col(host).alias("__of")))
    rates = sent_if_small(host_rates(judged, "__of").select("__host", "shrunk_rate"))
    return judged.join(rates, judged["__of"].eqNullSafe(rates["__host"]), "left").select(
        *cols, *METRICS, F.col("shrunk_rate").alias("host_rate"), (~F.col("base_failed") & (F.col("shrunk_rate") <= max_host_rate)).alias("kept")
    )


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with their own columns, whatever those are called. The texts are read twice and shuffled only
    if the rejected documents are too many to be sent: rows are told apart by id and a checksum of id, text and host."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = lambda c: f"__c{names.index(c)}"
    marked = plain.withColumn("__check", F.xxhash64(own(id), own(text), own(host)))
    judged = judge(marked, (own(id), "__check"), own(text), own(host), max_host_rate)
    bad = cut(judged.where(~F.col("kept")).select(F.col(own(id)).alias("__bad"), F.col("__check").alias("__bad_check")).distinct())
    same = F.col(own(id)).eqNullSafe(F.col("__bad")) & (F.col("__check") == F.col("__bad_check"))
    return marked.join(sent_if_small(bad), same, "left_anti").select(*plain.columns).toDF(*names)
