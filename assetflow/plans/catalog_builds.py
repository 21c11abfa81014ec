"""Registered queries, continued: functions, blocks, incremental builds, manifest, user functions, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions import paths as pa
from ..functions import text as tx
from ..functions import times as tm
from ..operators import blocks as bl
from ..operators import incremental as inc
from ..operators import joins as jn
from ..operators import manifest as mf
from ..operators import work as wk
from ..sources import store
from ..streaming.progress import incremental_arrivals, manifest_sink, throttled_progress, write_listing
from . import views as v
from .catalog import directories_of, full, manifest_of, query, seconds
from .pipeline import foreach_step, incremental_run, pipeline_run

# ---- scalar functions


@query("f1_f3_separators", r"SELECT page_id, replace(path, '/', '\') AS win, replace(replace(path, '/', '\'), '\', '/') AS unix, regexp_replace(replace(path, '/', '\') || '" + '"' + r"', '([\\" + '"' + r"])', '\\\1', 'g') AS esc FROM v_paths")
def f1(spark, sf):
    w = tx.win(F.col("path"))
    return v.paths(spark, sf).select("page_id", w.alias("win"), tx.unix(w).alias("unix"), tx.escape(F.concat(w, F.lit('"'))).alias("esc"))


_CASES = "SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS up, lower(text) AS low FROM documents"


@query("f4_upper_lower", _CASES)
@query("f4_upper_lower_whole", _CASES)
def f4(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", F.upper("text").alias("up"), F.lower("text").alias("low"))


@query("f5_replace", r"SELECT page_id, regexp_replace(path, '/([a-z]+)/', '<\1$>', 'g') AS path FROM v_paths")
def f5(spark, sf):
    return v.paths(spark, sf).select("page_id", tx.replace_delimited(F.col("path"), r"|/([a-z]+)/|<\1$>|").alias("path"))


_PARTS = "SELECT doc_id, t[2:] AS a, CASE WHEN length(t) < 3 THEN t ELSE right(t, 3) END AS b, substring(t, 4, 2) AS c, substring(t, 2, 2) AS d, substring(t, greatest(length(t) - 3 + 1 - 2, 1), least(2, greatest(length(t) - 3, 0))) AS e FROM (SELECT doc_id, text AS t FROM documents)"


@query("f6_substr", _PARTS)
@query("f6_substr_whole", _PARTS)
def f6(spark, sf):
    t = F.col("text")
    return v.read(spark, sf, "documents").select("doc_id", tx.substr(t, 1).alias("a"), tx.substr(t, -3).alias("b"), tx.substr(t, 3, 2).alias("c"), tx.substr(t, 3, -2).alias("d"), tx.substr(t, -3, -2).alias("e"))


@query("f7_f10_path_parts", r"SELECT page_id, CASE WHEN ends_with(path, '/') THEN rtrim(path, '/') ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS directory, CASE WHEN ends_with(path, '/') THEN '.' ELSE regexp_extract(path, '([^/]*)$', 1) END AS filename, CASE WHEN ends_with(path, '/') THEN '.' ELSE regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') END AS file, CASE WHEN ends_with(path, '/') THEN '' ELSE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\.[^.]*)$', 1) END AS extension FROM v_paths")
def f7(spark, sf):
    p = F.col("path")
    return v.paths(spark, sf).select("page_id", pa.directory(p).alias("directory"), pa.filename(p).alias("filename"), pa.stem(p).alias("file"), pa.extension(p).alias("extension"))


@query("f11_f15_path_forms", r"SELECT page_id, path AS separated, path AS reduced, rtrim(path, '/') AS normal, path = split_part(path, '/', 1) || '/en' OR starts_with(path, split_part(path, '/', 1) || '/en/') AS based, CASE WHEN starts_with(path, split_part(path, '/', 1) || '/') THEN './' || regexp_replace(rtrim(path, '/'), '^[^/]*/', '') ELSE path END AS rest FROM v_paths")
def f11(spark, sf):
    p = F.col("path")
    messy = F.regexp_replace(p, "/", "//")
    host = F.split(p, "/")[0]
    return v.paths(spark, sf).select(
        "page_id", pa.correct_separator(F.regexp_replace(p, "/", r"\\\\/")).alias("separated"), pa.reduce_slashes(messy).alias("reduced"),
        pa.normalize(F.concat(F.lit("./x/../"), p)).alias("normal"), pa.has_base(p, F.concat(host, F.lit("//x/../en/"))).alias("based"), pa.remove_base(p, host, relative=True).alias("rest"),
    )


@query("f16_to_bool", "SELECT doc_id, quality = 1 AS flag FROM labels")
def f16(spark, sf):
    return v.read(spark, sf, "labels").select("doc_id", tx.to_bool(F.when(F.col("quality") == 1, "TRUE").otherwise("false")).alias("flag"))


_SIZE = "CASE WHEN b = 1 THEN '1 byte' WHEN b <= 1024 THEN b || ' bytes' WHEN b <= 1048576 THEN printf('%.1f KiB', b / 1024::DOUBLE) WHEN b <= 1073741824 THEN printf('%.1f MiB', b / 1048576::DOUBLE) WHEN b <= 1099511627776 THEN printf('%.1f GiB', b / 1073741824::DOUBLE) ELSE printf('%.1f TiB', b / 1099511627776::DOUBLE) END"


@query("f17_human_size", f"SELECT doc_id, CASE WHEN b > 1073741824 THEN 3 WHEN b > 1048576 THEN 2 WHEN b > 1024 THEN 1 ELSE 0 END AS step, {_SIZE} AS size FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)")
def f17(spark, sf):
    b = F.col("n_chars") * F.col("n_chars")
    return v.read(spark, sf, "documents").select("doc_id", tx.size_step(b).alias("step"), tx.human_size(b).alias("size"))


@query("f17_human_size_whole", f"SELECT doc_id, {_SIZE} AS size FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)")
def f17_whole(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", tx.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("f18_f20_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || strftime(ts, '%g') AS text, epoch(date_trunc('second', ts))::BIGINT AS unix, epoch(date_trunc('second', ts))::BIGINT + 2208988800 AS sql, epoch(date_trunc('second', ts))::BIGINT AS back FROM events")
def f18(spark, sf):
    t = F.col("ts").cast("timestamp")
    return v.read(spark, sf, "events").select("event_id", tm.format_millis(t).alias("text"), tm.to_unix_time(t).alias("unix"), tm.to_sql_time(t).alias("sql"), tm.to_unix_time(tm.from_sql_time(tm.to_sql_time(tm.from_unix_time(tm.to_unix_time(t))))).alias("back"))


@query("f21_parse_key_value", "SELECT event_id, CASE WHEN user_id % 3 > 0 THEN event_type END AS key, CASE WHEN user_id % 3 > 0 THEN user_id || '=x' END AS value FROM events")
def f21(spark, sf):
    text = F.concat(F.when(F.col("user_id") % 3 > 0, F.col("event_type")).otherwise("1"), F.lit("="), F.col("user_id").cast("string"), F.lit("=x"))
    kv = tx.parse_key_value(text)
    return v.read(spark, sf, "events").select("event_id", kv["key"].alias("key"), kv["value"].alias("value"))


@query("f22_flags", "SELECT l_orderkey, l_linenumber, l_partkey, (f & 3) = 3 AS has, f | 8 AS added, f & ~2 AS removed FROM (SELECT *, (l_suppkey % 32)::BIGINT AS f FROM lineitem)")
def f22(spark, sf):
    f = (F.col("l_suppkey") % 32).cast("long")
    return v.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fl.has_flags(f, 3).alias("has"), fl.set_flags(f, 8, True).alias("added"), fl.set_flags(f, 2, False).alias("removed"))


# ---- blocks


def _two(df):
    return bl.foreach(df, {"destination": "out/{source}/{?:file}.a", "destination[0]": "out/{source}/{?:file}.b"}, scope={"source": F.col("source")})


@query("d1_d7_foreach", "SELECT ord AS transition_id, path AS dependency, k AS out_ord, 'out/' || source || '/doc_' || ord || CASE k WHEN 0 THEN '.a' ELSE '.b' END AS output FROM v_assets, range(2) r(k) WHERE lang = 'en'")
def d1(spark, sf):
    return _two(bl.select_inputs(v.assets(spark, sf), ".*/en/.*")).select("transition_id", "dependency", F.col("out_ord").cast("long").alias("out_ord"), "output")


@query("d2_all", "SELECT source, min(ord) AS transition_id, 'all/' || source || '_' || min_by(lang, ord) AS output, string_agg(path, ' ' ORDER BY ord) AS inputs, count(*) AS n_inputs, max(mtime) AS in_mtime FROM v_assets GROUP BY source")
def d2(spark, sf):
    named = bl.select_inputs(v.assets(spark, sf).drop("lang"), r"[^/]*/(?<lang>[a-z]+)/.*")
    out = bl.all_of(named, {"destination": "all/{source}_{lang}"}, by=["source"], names=("lang",), scope={"source": F.col("source")})
    return seconds(out.select("source", "transition_id", "output", "inputs", "n_inputs", "in_mtime"), "in_mtime")


@query("d3_none", "SELECT 0::BIGINT AS transition_id, 'out/' || n AS output FROM (SELECT count(*) AS n FROM documents)")
def d3(spark, sf):
    # A block without inputs writes one output, here named after a number that the tables give.
    n = v.read(spark, sf, "documents").count()
    return bl.none(spark, {"destination": "out/{n}"}, {"n": F.lit(n).cast("string")}).select("transition_id", "output")


@query("d4_d5_then_also", "SELECT 'c/' || x AS output, count(*) AS n FROM (SELECT 'a/doc_' || ord || '.1' AS x FROM v_assets UNION ALL SELECT 'b/doc_' || ord || '.2' FROM v_assets) GROUP BY 1")
def d4(spark, sf):
    one = lambda df: bl.as_inputs(bl.foreach(df, {"destination": "a/{?:file}.1"}))
    two = lambda df: bl.as_inputs(bl.foreach(df, {"destination": "b/{?:file}.2"}))
    last = lambda df: bl.foreach(df, {"destination": "c/{?}"})
    return bl.then(bl.also(one, two), last)(v.assets(spark, sf)).groupBy("output").agg(F.count("*").alias("n"))


@query("d6_include_blocks", "SELECT 'x/' || ord AS output FROM v_assets UNION ALL SELECT 'y/' || ord FROM v_assets")
def d6(spark, sf):
    make = lambda p: lambda df: bl.foreach(df, {"destination": p + "/{ord}"}, scope={"ord": F.col("ord").cast("string")}).select("output")
    return bl.include_blocks("C", {"A": [make("x")], "B": [make("y")]}, ["A", "B"])(v.assets(spark, sf))


@query("d8_force", "SELECT ord AS transition_id, 8::BIGINT AS flags FROM v_assets")
def d8(spark, sf):
    return bl.force(bl.foreach(v.assets(spark, sf), {"destination": "{?}.o"})).select("transition_id", "flags")


@query("d9_dag_level", "WITH c AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations), m AS (SELECT conv_id, turn, turn - min(turn) OVER (PARTITION BY conv_id, g) AS level, count(*) OVER (PARTITION BY conv_id, g) AS n FROM c) SELECT 'conv/' || conv_id || '/' || turn AS node, level::BIGINT AS level FROM m WHERE turn > 0 OR n > 1")
def d9(spark, sf):
    return inc.dag_level(v.chain(spark, sf)).withColumn("level", F.col("level").cast("long"))


# ---- incremental builds


@query("i1_was_modified", "SELECT transition_id, dep_ord, dependency, coalesce(dep_mtime >= out_mtime + 1, false) AS changed FROM v_edges")
def i1(spark, sf):
    return v.edges(spark, sf).select("transition_id", "dep_ord", "dependency", tm.was_modified(F.col("dep_mtime"), F.col("out_mtime")).alias("changed"))


def _marked(spark, sf):
    """Each document with its output: some inputs modified, some temporaries, some forced."""
    a, o = v.assets(spark, sf), v.outputs(spark, sf)
    j = a.join(o.select("ord", F.col("mtime").alias("out_mtime"), F.col("flags").alias("o")), "ord", "left")
    return j.select(
        F.col("ord").alias("transition_id"), F.col("path").alias("dependency"), F.regexp_replace("path", r"\.txt$", ".out").alias("output"), "out_mtime", F.col("mtime").alias("in_mtime"),
        F.when(F.col("ord") % 6 == 0, 2).otherwise(0).cast("long").alias("flags"), (F.lit(17) + F.when(F.col("ord") % 13 == 0, 4).otherwise(0) + F.when(F.col("ord") % 17 == 0, 8).otherwise(0)).cast("long").alias("in_flags"),
        F.when(F.col("ord") % 9 == 0, F.col("mtime") + F.expr("INTERVAL 2 HOURS")).alias("dep_mtime"),
    )


_MARKED = """
WITH j AS (SELECT a.ord, a.path, a.mtime AS im, o.mtime AS om, CASE WHEN a.ord % 6 = 0 THEN 2 ELSE 0 END AS tf, 17 + CASE WHEN a.ord % 13 = 0 THEN 4 ELSE 0 END + CASE WHEN a.ord % 17 = 0 THEN 8 ELSE 0 END AS inf, CASE WHEN a.ord % 9 = 0 THEN a.mtime + 7200 END AS dm
  FROM v_assets a LEFT JOIN v_outputs o ON o.ord = a.ord),
k AS (SELECT *, (tf | CASE WHEN om IS NOT NULL THEN 16 ELSE 0 END
  | CASE WHEN coalesce(im >= om + 1, false) OR coalesce(dm >= om + 1, false) OR (inf & 4) <> 0 THEN 4 ELSE 0 END | CASE WHEN (inf & 8) <> 0 THEN 12 ELSE 0 END)::BIGINT AS flags,
  CASE WHEN om IS NOT NULL THEN om WHEN tf = 2 THEN CASE WHEN dm > im THEN dm ELSE im END END AS mtime FROM j)
"""


@query("i2_mark_outputs", _MARKED + "SELECT ord AS transition_id, flags, mtime FROM k")
def i2(spark, sf):
    return seconds(inc.mark_outputs(_marked(spark, sf)).select("transition_id", "flags", "mtime"), "mtime")


_REASON = """, r AS (SELECT ord AS transition_id,
  (CASE WHEN inf & 4 <> 0 THEN 4 ELSE 0 END + CASE WHEN inf & 8 <> 0 THEN 1 ELSE 0 END)::BIGINT AS di,
  (CASE WHEN flags & 4 <> 0 THEN 4 ELSE 0 END + CASE WHEN flags & 18 = 0 THEN 2 ELSE 0 END + CASE WHEN flags & 8 <> 0 THEN 1 ELSE 0 END)::BIGINT AS oi FROM k),
q AS (SELECT transition_id, CASE WHEN di <> 0 THEN di ELSE oi END AS reason, di | oi AS all_reasons FROM r)
"""


def _reasons(spark, sf):
    m = inc.mark_outputs(_marked(spark, sf))
    deps = m.select("transition_id", F.lit("dependency").alias("role"), F.lit(0).alias("ord"), F.col("in_flags").alias("flags"))
    outs = m.select("transition_id", F.lit("output").alias("role"), F.lit(0).alias("ord"), "flags")
    out = inc.needs_build_reasons(m.select("transition_id"), deps.unionByName(outs))
    return out.withColumns({c: F.col(c).cast("long") for c in ("reason", "all_reasons")})


@query("i3_needs_build", _MARKED.rstrip() + _REASON + "SELECT * FROM q")
def i3(spark, sf):
    return _reasons(spark, sf)


@query("i4_i5_build_plan", _MARKED.rstrip() + _REASON + "SELECT *, '[' || CASE WHEN reason & 1 <> 0 THEN 'F' ELSE ' ' END || CASE WHEN reason & 2 <> 0 THEN 'M' ELSE ' ' END || CASE WHEN reason & 4 <> 0 THEN 'C' ELSE ' ' END || ']' AS text FROM q WHERE reason <> 0")
def i5(spark, sf):
    return inc.build_plan(_reasons(spark, sf))


@query("stale_orders", "SELECT transition_id, max(dep_mtime) AS newest, count(dependency) AS dependencies, CASE WHEN count(dependency) = 0 THEN '[ M ]' ELSE '[  C]' END AS text FROM v_edges GROUP BY transition_id, out_mtime HAVING count(dependency) = 0 OR max(dep_mtime) >= out_mtime + 1")
def stale_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: which orders are out of date against their line items, and why. One join, one aggregate."""
    e = v.edges(spark, sf)
    per = e.groupBy("transition_id", "out_mtime").agg(F.max("dep_mtime").alias("newest"), F.count("dependency").alias("dependencies"))
    reason = F.when(F.col("dependencies") == 0, 2).when(tm.was_modified(F.col("newest"), F.col("out_mtime")), 4).otherwise(0)
    return seconds(inc.build_plan(per.withColumn("reason", reason)).select("transition_id", "newest", "dependencies", "text"), "newest")


@query("i6_propagate_forced", "WITH c AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) SELECT 'conv/' || conv_id || '/' || turn AS path, conv_id % 4 = 1 AND min(turn) OVER (PARTITION BY conv_id, g) = 0 AS forced FROM c")
def i6(spark, sf):
    return inc.propagate_forced(v.chain_assets(spark, sf), v.chain(spark, sf))


_CLOSE = """
WITH up(temporary, e, et) AS (SELECT output, dependency, dep_temp FROM v_chain WHERE out_temp UNION SELECT up.temporary, c.dependency, c.dep_temp FROM up JOIN v_chain c ON c.output = up.e WHERE up.et),
down(temporary, e, et) AS (SELECT dependency, output, out_temp FROM v_chain WHERE dep_temp UNION SELECT down.temporary, c.output, c.out_temp FROM down JOIN v_chain c ON c.dependency = down.e WHERE down.et),
ti AS (SELECT temporary, list_sort(coalesce(list(DISTINCT e) FILTER (NOT et), [])) AS inputs, max(mtime) AS newest_input, coalesce(bool_and(flags & 16 <> 0) FILTER (NOT et), true) AS all_input_exists, coalesce(bool_or(NOT et AND flags & 4 <> 0), false) AS input_was_modified FROM up LEFT JOIN v_chain_assets ON path = e GROUP BY temporary),
tu AS (SELECT temporary, list_sort(coalesce(list(DISTINCT e) FILTER (NOT et), [])) AS outputs, min(mtime) AS oldest_output, coalesce(bool_and(flags & 16 <> 0) FILTER (NOT et), true) AS all_output_exists, coalesce(bool_or(NOT et AND flags & 12 <> 0), false) AS output_will_be_modified FROM down LEFT JOIN v_chain_assets ON path = e GROUP BY temporary)
"""


@query("i7_temporary_inputs", _CLOSE + "SELECT * FROM ti", recursive=True)
def i7(spark, sf):
    return seconds(inc.temporary_inputs(v.chain(spark, sf), v.chain_assets(spark, sf)), "newest_input")


@query("i8_temporary_outputs", _CLOSE + "SELECT * FROM tu", recursive=True)
def i8(spark, sf):
    return seconds(inc.temporary_outputs(v.chain(spark, sf), v.chain_assets(spark, sf)), "oldest_output")


_DECIDED = _CLOSE + "SELECT path, (CASE WHEN NOT (coalesce(all_input_exists, true) AND coalesce(all_output_exists, true)) THEN flags | 8 WHEN coalesce(newest_input >= oldest_output + 1, false) OR coalesce(input_was_modified, false) OR coalesce(output_will_be_modified, false) THEN flags | 12 ELSE flags END)::BIGINT AS flags FROM v_chain_assets LEFT JOIN ti ON ti.temporary = path LEFT JOIN tu ON tu.temporary = path WHERE flags & 2 <> 0"


@query("i9_decide_temporaries", _DECIDED, recursive=True)
def i9(spark, sf):
    edges, assets = v.chain(spark, sf), v.chain_assets(spark, sf)
    return inc.decide_temporaries(assets.where(fl.has_flags(F.col("flags"), 2)), inc.temporary_inputs(edges, assets), inc.temporary_outputs(edges, assets))


@query("i9_temporary_states", _DECIDED, recursive=True)
def i9_states(spark, sf):
    edges, assets = v.chain(spark, sf), v.chain_assets(spark, sf)
    return inc.decide_temporaries(assets.where(fl.has_flags(F.col("flags"), 2)), *inc.temporary_states(edges, assets))


_DONE = "d AS (SELECT transition_id FROM v_commands GROUP BY transition_id HAVING bool_and(state = 'FINISHED' AND output_exists))"


def _finished(spark, sf):
    c = v.commands(spark, sf).groupBy("transition_id").agg(F.bool_and((F.col("state") == "FINISHED") & F.col("output_exists")).alias("ok")).where("ok")
    return v.edges(spark, sf).where("dependency IS NOT NULL").join(c, "transition_id", "left_semi").select("output", "dependency")


def _pending(spark, sf):
    return v.edges(spark, sf).where("dependency IS NOT NULL").select("output", "dependency").distinct()


@query("i10_settle_dependents", f"WITH {_DONE} SELECT DISTINCT output, dependency FROM v_edges WHERE dependency IS NOT NULL AND transition_id NOT IN (SELECT transition_id FROM d)")
def i10(spark, sf):
    return inc.settle_dependents(_pending(spark, sf), _finished(spark, sf))


@query("i11_deletable_temporaries", f"WITH {_DONE} SELECT 'part/' || p_partkey AS path FROM part WHERE p_partkey % 2 = 0 AND 'part/' || p_partkey NOT IN (SELECT dependency FROM v_edges WHERE dependency IS NOT NULL AND transition_id NOT IN (SELECT transition_id FROM d))")
def i11(spark, sf):
    t = v.read(spark, sf, "part").select(F.concat_ws("/", F.lit("part"), "p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(1).cast("long").alias("flags"))
    return inc.deletable_temporaries(t, inc.settle_dependents(_pending(spark, sf), _finished(spark, sf)))


def _outs(spark, sf):
    return v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("transition_id"), F.concat_ws("/", F.lit("order"), "o_orderkey").alias("output"))


def _missing(spark, sf):
    return v.read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("transition_id"))


@query("i12_incomplete_outputs", "SELECT o_orderkey AS transition_id, 'order/' || o_orderkey AS output FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT transition_id FROM v_commands WHERE state IN ('IDLE', 'RUNNING'))")
def i12(spark, sf):
    return inc.incomplete_outputs(_outs(spark, sf), v.commands(spark, sf), _missing(spark, sf))


@query("i13_sweep_remains", "SELECT 'remains' AS what, path, NULL::BIGINT AS flags FROM v_manifest_old WHERE path NOT IN (SELECT path FROM v_manifest_new) UNION ALL SELECT 'manifest', path, flags FROM v_manifest_new")
def i13(spark, sf):
    gone, now = inc.sweep_remains(v.manifest_old(spark, sf), v.manifest_new(spark, sf))
    return gone.select(F.lit("remains").alias("what"), "path", F.lit(None).cast("long").alias("flags")).unionByName(now.select(F.lit("manifest").alias("what"), "path", "flags"))


@query("i14_missing_outputs", "SELECT o_orderkey AS transition_id, 'order/' || o_orderkey AS output FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def i14(spark, sf):
    made = v.read(spark, sf, "lineitem").select(F.concat_ws("/", F.lit("order"), "l_orderkey").alias("path")).distinct()
    return inc.missing_outputs(_outs(spark, sf), made, _missing(spark, sf))


_RUN = _MARKED.replace("a.ord % 6 = 0 THEN 2", "false THEN 2").replace("a.ord % 9 = 0", "false").replace("a.ord % 13 = 0", "false").replace("a.ord % 17 = 0", "false")


@query("i15_incremental_run", _RUN + "SELECT replace(path, '.txt', '.out') AS path, om IS NULL OR im >= om + 1 AS built, om IS NOT NULL AS existed FROM k")
def i15(spark, sf):
    a = v.assets(spark, sf)
    transitions = bl.foreach(a, {"destination": "{?:directory}/{?:file}.out"}).select("transition_id", "dependency", "output", "flags")
    stored = v.outputs(spark, sf).select("path", "mtime", F.lit(16).cast("long").alias("flags"))
    run = incremental_run(transitions, a, stored, lambda row: len(row.output))
    built = run.log.select(F.col("output").alias("path"), F.lit(True).alias("b"))
    kept = stored.select("path", F.lit(True).alias("s"))
    return run.manifest.select("path").join(built, "path", "left").join(kept, "path", "left").select("path", F.coalesce("b", F.lit(False)).alias("built"), F.coalesce("s", F.lit(False)).alias("existed"))


_CHAIN = """
WITH s AS (SELECT source, min_by(path, ord) AS first FROM v_assets GROUP BY source),
j AS (SELECT a.path, a.mtime AS im, o.mtime AS om, f.mtime AS dm FROM v_assets a LEFT JOIN v_outputs o ON o.ord = a.ord JOIN s ON s.source = a.source JOIN v_assets f ON f.path = s.first),
k AS (SELECT *, om IS NULL OR im >= om + 1 OR dm >= om + 1 AS due FROM j)
SELECT replace(path, '.txt', '.out') AS path, due AS built, 16::BIGINT AS flags, false AS deleted FROM k UNION ALL SELECT replace(path, '.txt', '.tmp'), due, 2::BIGINT, due FROM k
"""


@query("i15_pipeline_run", _CHAIN)
def i15_chain(spark, sf):
    # Two steps: a temporary of each document, and its output, which also depends on the source's first document.
    a = v.assets(spark, sf)
    tmp = bl.foreach(a, {"destination": "{?:directory}/{?:file}.tmp"}, temporary=frozenset({"destination"}))
    first = a.groupBy("source").agg(F.min_by("path", "ord").alias("first"))
    out = foreach_step("out", bl.foreach(bl.as_inputs(tmp), {"destination": "{?:directory}/{?:file}.out"}))
    both = out.withColumn("source", F.split("output", "/")[0]).join(first, "source", "left").select("transition_id", F.posexplode(F.array("dependency", "first")).alias("dep_ord", "dependency"), "output", "out_ord", "flags")
    both = both.where("dependency IS NOT NULL").withColumn("dep_ord", F.col("dep_ord").cast("long"))
    there = v.outputs(spark, sf).select("path", "mtime", F.lit(16).cast("long").alias("flags"))
    run = pipeline_run(foreach_step("tmp", tmp).unionByName(both), a.select("path", "mtime", "flags").unionByName(there), there.select("path", "flags"), lambda row: len(row.outputs))
    built = run.log.select(F.explode("outputs").alias("path"), F.lit(True).alias("b"))
    gone = run.deletable.select("path", F.lit(True).alias("d"))
    return run.manifest.select("path", "flags").join(built, "path", "left").join(gone, "path", "left").select("path", F.coalesce("b", F.lit(False)).alias("built"), "flags", F.coalesce("d", F.lit(False)).alias("deleted"))


# ---- manifest


def _both(spark, sf):
    old, new = v.manifest_old(spark, sf), v.manifest_new(spark, sf)
    d = directories_of(old.select("path").unionByName(new.select("path")))
    return manifest_of(old, d), manifest_of(new, d), d


@query("m1_upsert", "SELECT path, size, mtime AS last_modified, flags FROM v_manifest_new UNION ALL SELECT path, size, mtime, flags FROM v_manifest_old WHERE path NOT IN (SELECT path FROM v_manifest_new)")
def m1(spark, sf):
    old, new, d = _both(spark, sf)
    return full(mf.upsert(old, new.withColumn("seq", F.lit(1))), d)


@query("m2_set_flags", "SELECT path, CASE WHEN path IN (SELECT path FROM v_manifest_new) THEN 16 ELSE flags END::BIGINT AS flags FROM v_manifest_old")
def m2(spark, sf):
    old, new, d = _both(spark, sf)
    return full(mf.set_flags(old, new), d).select("path", "flags")


@query("m3_add_flags", "SELECT path, (flags | CASE WHEN path IN (SELECT path FROM v_manifest_new) THEN 16 ELSE 0 END)::BIGINT AS flags FROM v_manifest_old")
def m3(spark, sf):
    old, new, d = _both(spark, sf)
    return full(mf.add_flags(old, new), d).select("path", "flags")


@query("m4_delete", "SELECT path, flags FROM v_manifest_old WHERE path NOT IN (SELECT path FROM v_manifest_new)")
def m4(spark, sf):
    old, new, d = _both(spark, sf)
    return full(mf.delete(old, new), d).select("path", "flags")


@query("m5_m6_masks", "SELECT 'none' AS mask, path FROM v_manifest_old WHERE flags = 0 UNION ALL SELECT 'two', path FROM v_manifest_old WHERE flags & 2 = 2 UNION ALL SELECT 'without', path FROM v_manifest_old WHERE flags & 2 <> 2")
def m5(spark, sf):
    old, _, d = _both(spark, sf)
    cases = {"none": mf.select_mask(old, 0), "two": mf.select_mask(old, 2), "without": mf.delete_mask(old, 2)}
    out = None
    for k, df in cases.items():
        part = jn.manifest_join(df, d).select(F.lit(k).alias("mask"), "path")
        out = part if out is None else out.unionByName(part)
    return out


# ---- user functions and streams


@query("v1_run_foreach", "SELECT doc_id, CASE WHEN n_chars % 10 = 0 THEN 'FAILED' WHEN n_chars % 10 = 1 THEN 'FAILED' ELSE 'FINISHED' END AS state, (CASE WHEN n_chars % 10 = 0 THEN -1 WHEN n_chars % 10 = 1 THEN 1 ELSE 0 END)::BIGINT AS exit_code, CASE WHEN n_chars % 10 > 1 THEN (n_chars * 2)::VARCHAR END AS result FROM documents")
def v1(spark, sf):
    def work(row):
        if row.n_chars % 10 == 0:
            raise ValueError("can't start")
        return (-5, None) if row.n_chars % 10 == 1 else (0, row.n_chars * 2)

    out = wk.run_foreach(v.read(spark, sf, "documents").select("doc_id", "n_chars"), work)
    return out.select("doc_id", "state", F.col("exit_code").cast("long").alias("exit_code"), "result")


@query("v2_run_all", "SELECT source, 'FINISHED' AS state, sum(n_chars)::VARCHAR AS result FROM documents GROUP BY source")
def v2(spark, sf):
    docs = v.read(spark, sf, "documents").select("source", "n_chars")
    return wk.run_all(docs, ["source"], lambda rows: int(rows["n_chars"].sum())).select("source", "state", "result")


@query("v2_run_all_merged", "SELECT source, 'FINISHED' AS state, sum(n_chars)::VARCHAR AS result FROM documents GROUP BY source")
def v2_merged(spark, sf):
    docs = v.read(spark, sf, "documents").select("source", "n_chars")
    return wk.run_all_merged(docs, ["source"], lambda rows: int(rows["n_chars"].sum()), lambda sums: sum(map(int, sums))).select("source", "state", "result")


@query("v2_merged_in_order", "SELECT source, 'FINISHED' AS state, min(doc_id) || ':' || max(doc_id) || ':' || count(*) || ':True' AS result FROM documents GROUP BY source")
def v2_in_order(spark, sf):
    # First and last document of each source, and whether they come in order throughout.
    def joined(results: list[str]) -> str:
        cut = [r.split(":") for r in results]
        fits = all(c[3] == "True" for c in cut) and all(int(a[1]) < int(b[0]) for a, b in zip(cut[:-1], cut[1:], strict=True))
        return f"{cut[0][0]}:{cut[-1][1]}:{sum(int(c[2]) for c in cut)}:{fits}"

    part = lambda rows: joined([f"{i}:{i}:1:True" for i in rows["doc_id"]])
    docs = v.read(spark, sf, "documents").select("source", "doc_id")
    return wk.run_all_merged(docs, ["source"], part, joined, order=["source", "doc_id"]).select("source", "state", "result")


@query("x1_throttled_progress", "SELECT series, epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS n, sum(value) AS value FROM v_progress GROUP BY 1, 2")
def x1(spark, sf):
    return seconds(throttled_progress(v.progress(spark, sf)), "second")


@query("x2_incremental_arrivals", "SELECT path, size, mtime AS last_modified FROM v_manifest_new UNION ALL SELECT path, size, mtime FROM v_manifest_old WHERE path NOT IN (SELECT path FROM v_manifest_new)")
def x2(spark, sf):
    # Two listings, of which the second shows other times, and a run of the stream for each; the last run finds nothing new.
    root = f"{store.shared_folder(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    sink = manifest_sink(spark, f"{root}/manifest")
    for number, listing in enumerate((v.manifest_old(spark, sf), v.manifest_new(spark, sf), v.manifest_new(spark, sf))):
        write_listing(listing, f"{root}/listings", number)
        incremental_arrivals(spark, f"{root}/listings", f"{root}/checkpoint", sink).awaitTermination()
    return full(*store.read_manifest(spark, f"{root}/manifest")).drop("flags")
