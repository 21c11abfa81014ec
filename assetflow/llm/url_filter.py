"""URL rules by a sorted sweep over reversed-host keys.

Each rule is a host and a path prefix. Under one reversed host the rule's path prefix is an interval of sorted keys:
it starts at the path and ends just past every path that begins with it. URLs are points. One pass over the sorted
markers and points keeps the stack of nested rules that are open at each point: slot d of the stack is the last rule
that opened at depth d. Only built-in functions run.

Scale: a URL becomes one point per parent host that has a rule. Points are counted by host, and a host gets a salt for each
``SALT_ROWS`` of them; each salt gets the (few) markers of its host again, so that no window partition grows with a host's
share of the table.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; a URL of any length is judged
whole; repeated URLs and rows get the same verdict; an empty table gives an empty table; rules with a null or empty host are ignored; of equal rules, block
wins; of two fitting rules of the same length, the one of the longer host; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sent_if_small

#: Least number of salts of a host, and URLs of one salt, about.
SALTS = 8
SALT_ROWS = 20_000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z in lower case."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(path: Column, last: bool = False) -> Column:
    """Bytes sort as the sweep needs; 0xFF is in no UTF-8 text, so it closes a prefix's interval."""
    raw = path.cast("binary")
    return F.concat(raw, F.unhex(F.lit("FF"))) if last else raw


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int = SALTS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: host, path, verdict (``block`` or ``allow``)."""
    made = ("host", "path", "rule", "verdict")
    kept = (
        rules.select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(F.array_join(_labels(F.col("host")), ".").alias("__site"), F.size(_labels(F.col("host"))).alias("__labels"), "host", "path", "verdict")
    )
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("long"),
        F.length("host").alias("host_long"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    opens = kept.select("__site", _key(F.col("path")).alias("__key"), F.lit(0).alias("__kind"), F.lit(1).alias("__step"), rule.alias("__rule"))
    closes = kept.select("__site", _key(F.col("path"), True).alias("__key"), F.lit(2).alias("__kind"), F.lit(-1).alias("__step"), rule.alias("__rule"))
    markers = opens.unionByName(closes)
    # Two numbers bound the work: the labels of the longest rule host and the deepest nesting of rules.
    depth = F.sum("__step").over(Window.partitionBy("__site").orderBy("__key", "__kind"))
    deepest = markers.withColumn("__d", depth).agg(F.max("__d")).first()[0] or 0
    most = kept.agg(F.max("__labels")).first()[0] or 0
    if not deepest:
        return pages.drop(*made).withColumns(
            {"host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
        )

    urls = pages.where(F.col(url).contains("://")).groupBy(F.col(url).alias("__url")).agg(F.lit(1).alias("__one"))
    parents = F.transform(
        F.sequence(F.lit(1), F.least(F.size("__labels"), F.lit(most))), lambda n: F.array_join(F.slice("__labels", F.lit(1), n), ".")
    )
    points = (
        urls.select("__url", _labels(host_of(F.col("__url"))).alias("__labels"), path_of(F.col("__url")).alias("__path"))
        .select("__url", F.explode(parents).alias("__site"), _key(F.col("__path")).alias("__key"))
        .join(kept.select("__site").distinct(), "__site", "left_semi")
        .select(
            "__site", "__key", F.lit(1).alias("__kind"), F.lit(0).alias("__step"),
            F.lit(None).cast(markers.schema["__rule"].dataType).alias("__rule"), "__url",
        )
    )
    sites = cut(points.groupBy("__site").agg(F.greatest(F.lit(salts), F.ceil(F.count("*") / salt_rows)).cast("long").alias("__salts")))
    sized = sent_if_small(sites)  # at most one row for each rule
    points = points.join(sized, "__site").withColumn("__salt", F.pmod(F.xxhash64("__url"), "__salts")).drop("__salts")
    dealt = markers.join(sized, "__site").select(*markers.columns, F.lit(None).cast("string").alias("__url"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1)).alias("__salt"))
    sweep = Window.partitionBy("__site", "__salt").orderBy("__key", "__kind")
    open_now = points.unionByName(dealt).withColumn("__depth", F.sum("__step").over(sweep))
    stack = F.array(*[F.last(F.when((F.col("__kind") == 0) & (F.col("__depth") == d), F.col("__rule")), ignorenulls=True).over(sweep) for d in range(1, deepest + 1)])
    verdicts = (
        open_now.withColumn("__stack", stack)
        .where("__kind = 1 AND __depth > 0")
        .groupBy("__url")
        .agg(F.max(F.expr("element_at(__stack, cast(__depth AS int))")).alias("__best"))
    )
    bare = pages.drop(*made)
    return bare.join(verdicts, bare[url] == verdicts["__url"], "left").select(
        *[bare[c] for c in bare.columns],
        host_of(bare[url]).alias("host"),
        path_of(bare[url]).alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
