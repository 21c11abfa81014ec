"""Asset tables derived from the given tables, in Spark and as SQL text with the same columns (times as whole seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("size"),
        F.timestamp_seconds(F.lit(START) + F.col("doc_id") * 37).alias("mtime"), F.lit(17).cast("long").alias("flags"), F.create_map().cast("map<string,string>").alias("captures"), "source", "lang",
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    shift = F.when(F.col("quality") == 1, 3600).otherwise(-3600)
    return j.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".out")).alias("path"), F.col("doc_id").alias("ord"),
        F.timestamp_seconds(F.lit(START) + F.col("doc_id") * 37 + shift).alias("mtime"), (F.lit(16) + F.when(F.col("toxic") == 1, 2).otherwise(0)).cast("long").alias("flags"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are outputs, their line items dependencies; an order without items keeps a null dependency."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transition_id"), F.col("o_orderdate").cast("timestamp").alias("out_mtime"))
    i = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transition_id"), F.concat_ws("/", F.lit("part"), "l_partkey").alias("dependency"), F.col("l_shipdate").cast("timestamp").alias("dep_mtime"), F.col("l_linenumber").cast("long").alias("dep_ord"),
        "l_returnflag",
    )
    return o.join(i, "transition_id", "left").withColumn("output", F.concat_ws("/", F.lit("order"), "transition_id"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation depends on the turn before; even turns are temporary."""
    c = read(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("/", F.lit("conv"), "conv_id", t)
    temp = lambda t: (t % 2 == 0)
    now, before = F.col("turn"), F.col("turn") - 1
    return c.where("turn > 0").select(name(now).alias("output"), name(before).alias("dependency"), temp(now).alias("out_temp"), temp(before).alias("dep_temp"))


def chain_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    temp = F.col("turn") % 2 == 0
    exists = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), 0).otherwise(16)
    modified = F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 3), 4).otherwise(0)
    flags = F.when(temp, 2).otherwise(exists + modified).cast("long")
    return c.select(
        F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("path"), flags.alias("flags"),
        F.when(~temp, F.timestamp_seconds(F.lit(START) + F.col("conv_id") * 11 + F.when(F.col("conv_id") % 3 == 0, -F.col("turn")).otherwise(F.col("turn")))).alias("mtime"),
        (F.col("conv_id") % 4 == 1).__and__(F.col("turn") == 0).alias("forced"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.ceil("value").cast("double").alias("value"), "event_id")
    total = e.groupBy("series").agg(F.sum("value").alias("total"))
    return e.join(total, "series")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "lineitem")
    started = F.col("l_shipdate").cast("timestamp")
    return i.select(
        F.col("l_orderkey").alias("transition_id"), F.col("l_linenumber").cast("int").alias("cmd_ord"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("exit_code"), F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "O", "RUNNING").otherwise("FINISHED").alias("state"),
        started.alias("started"), (started + F.expr("make_interval(0, 0, 0, 0, 0, 0, l_quantity)")).alias("ended"), (F.col("l_tax") < 0.05).alias("output_exists"), F.concat_ws("-", "l_linestatus", "l_linenumber").alias("process"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"\A[a-z]+://([^?#]*)", 1).alias("path"))


def manifest_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).where("ord % 3 <> 0").select("path", "size", "mtime", (F.col("ord") % 4).alias("flags"), "ord")


def manifest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).where("ord % 2 = 0").select("path", (F.col("size") + 1).alias("size"), "mtime", F.lit(16).cast("long").alias("flags"), "ord")


SQL = {
    "v_assets": f"SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, doc_id AS ord, n_chars AS size, {START} + 37 * doc_id AS mtime, 17::BIGINT AS flags, source, lang FROM documents",
    "v_outputs": f"SELECT source || '/' || lang || '/doc_' || doc_id || '.out' AS path, doc_id AS ord, {START} + 37 * doc_id + CASE WHEN quality = 1 THEN 3600 ELSE -3600 END AS mtime, (16 + CASE WHEN toxic = 1 THEN 2 ELSE 0 END)::BIGINT AS flags FROM labels JOIN documents USING (doc_id)",
    "v_edges": "SELECT o_orderkey AS transition_id, epoch(o_orderdate)::BIGINT AS out_mtime, 'part/' || l_partkey AS dependency, epoch(l_shipdate)::BIGINT AS dep_mtime, l_linenumber::BIGINT AS dep_ord, l_returnflag, 'order/' || o_orderkey AS output FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
    "v_chain": "SELECT 'conv/' || conv_id || '/' || turn AS output, 'conv/' || conv_id || '/' || (turn - 1) AS dependency, turn % 2 = 0 AS out_temp, (turn - 1) % 2 = 0 AS dep_temp FROM conversations WHERE turn > 0",
    "v_chain_assets": f"SELECT 'conv/' || conv_id || '/' || turn AS path, (CASE WHEN turn % 2 = 0 THEN 2 ELSE CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 0 ELSE 16 END + CASE WHEN conv_id % 5 = 2 AND turn = 3 THEN 4 ELSE 0 END END)::BIGINT AS flags, CASE WHEN turn % 2 <> 0 THEN {START} + conv_id * 11 + CASE WHEN conv_id % 3 = 0 THEN -turn ELSE turn END END AS mtime, conv_id % 4 = 1 AND turn = 0 AS forced FROM conversations",
    "v_progress": "SELECT user_id AS series, ts, ceil(value)::DOUBLE AS value, event_id, sum(ceil(value)::DOUBLE) OVER (PARTITION BY user_id) AS total FROM events",
    "v_commands": "SELECT l_orderkey AS transition_id, l_linenumber AS cmd_ord, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exit_code, CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'O' THEN 'RUNNING' ELSE 'FINISHED' END AS state, l_quantity AS seconds, l_tax < 0.05 AS output_exists, l_linestatus || '-' || l_linenumber AS process FROM lineitem",
    "v_paths": r"SELECT page_id, regexp_extract(url, '\A[a-z]+://([^?#]*)', 1) AS path FROM pages",
    "v_manifest_old": "SELECT path, size, mtime, ord % 4 AS flags, ord FROM v_assets WHERE ord % 3 <> 0",
    "v_manifest_new": "SELECT path, size + 1 AS size, mtime, 16::BIGINT AS flags, ord FROM v_assets WHERE ord % 2 = 0",
}


def sql(text: str, recursive: bool = False) -> str:
    """``text`` behind the views that it names."""
    used = [v for v in SQL if v in text]
    used = [v for v in SQL if v in used or any(v in SQL[u] for u in used if u != v)]
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in used)
    text = text.strip()
    if text.upper().startswith("WITH "):
        text = ", " + text[5:].strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{text}" if head else f"WITH {'RECURSIVE ' if recursive else ''}{text[2:]}"
    return f"WITH {head} {text}" if head else text
