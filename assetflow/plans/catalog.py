"""The registered queries: one for each operator, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import blocks as bl
from ..operators import joins as jn
from ..operators import manifest as mf
from ..operators import predicates as pr
from ..operators import sets as st
from ..operators import windows as wn
from ..sources import scan, store
from . import views as v
from .template import Template, assign, unset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = v.sql(sql, recursive)
        return f

    return register


def seconds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_seconds(c) for c in columns})


def files_of(df: DataFrame) -> DataFrame:
    """(dir, file, size, last_modified, flags) of asset rows."""
    dir, file = mf.split_path(F.col("path"))
    return df.select(dir.alias("dir"), file.alias("file"), "size", F.col("mtime").alias("last_modified"), "flags")


def directories_of(df: DataFrame) -> DataFrame:
    none = df.sparkSession.range(0).select(F.col("id").alias("dir_id"), F.lit("").alias("dir"))
    return store.checkpointed(mf.extend_directories(none, df))


def manifest_of(df: DataFrame, directories: DataFrame) -> DataFrame:
    return files_of(df).join(directories, "dir").select("dir_id", "file", "size", "last_modified", "flags")


def full(manifest: DataFrame, directories: DataFrame) -> DataFrame:
    return seconds(jn.manifest_join(manifest, directories).select("path", "size", "last_modified", "flags"), "last_modified")


# ---- sources and sinks

_ASSET = "path, ord, size, mtime, flags"


@query("s1_scan_regex", r"SELECT path, ord, size, mtime, 17::BIGINT AS flags, regexp_extract(path, '^src([0-9]+)/(en|fr)/doc_([0-9]+)\.txt$', 3) AS doc FROM v_assets WHERE regexp_full_match(path, 'src([0-9]+)/(en|fr)/doc_([0-9]+)\.txt')")
def s1(spark, sf):
    out = scan.match_elements(v.assets(spark, sf).select("path", "ord", "size", "mtime"), r"src([0-9]+)/(?<lang>en|fr)/doc_(?<doc>[0-9]+)\.txt")
    return seconds(out.withColumn("doc", F.col("captures")["doc"]).drop("captures"), "mtime")


@query("s2_scan_recursive", f"SELECT {_ASSET} FROM v_assets WHERE regexp_full_match(path, '.*doc_[0-9]*7\\.txt')")
def s2(spark, sf):
    return seconds(scan.as_assets(v.assets(spark, sf).select("path", "ord", "size", "mtime"), r".*doc_[0-9]*7\.txt").drop("captures"), "mtime")


@query("s3_scan_wildcard", f"SELECT {_ASSET} FROM v_assets WHERE regexp_full_match(path, '.*/e./doc_[0-9][0-9]\\.txt')")
def s3(spark, sf):
    return seconds(scan.as_assets(v.assets(spark, sf).select("path", "ord", "size", "mtime"), pr.wildcard_regex("*/e?/doc_##.txt")).drop("captures"), "mtime")


@query("s1_s3_scan_files", "SELECT k AS scan, source, lang FROM (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), (VALUES ('regex'), ('levels'), ('recursive'), ('wildcard')) s(k) WHERE k <> 'wildcard' OR lang = 'en'")
def s1_files(spark, sf):
    # Real files: one or more for each source and language, found again by each kind of scan.
    root = f"{store.shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    v.read(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", "source", "lang").repartition("source", "lang").write.partitionBy("source", "lang").parquet(root)
    below = r"source=(?<source>.+)/lang=(?<lang>.+)/.*\.parquet"
    plain = scan.plain_path(F.lit(root))
    named = spark.range(1).select(plain.alias("p")).first()[0]
    out = {
        "regex": scan.scan_regex(spark, re.sub(r"([^A-Za-z0-9/])", r"\\\1", named) + "/" + below),
        "levels": scan.scan_by_levels(spark, re.sub(r"([^A-Za-z0-9/])", r"\\\1", named) + "/" + below),
        "recursive": scan.scan_recursive(spark, root, below),
        "wildcard": scan.scan_wildcard(spark, root, "source=*/lang=en/*.parquet").withColumn("captures", F.create_map(F.lit("source"), F.regexp_extract("path", "source=([^/]+)", 1), F.lit("lang"), F.lit("en"))),
    }
    made = [df.select(F.lit(k).alias("scan"), F.col("captures")["source"].alias("source"), F.col("captures")["lang"].alias("lang")) for k, df in out.items()]
    return st.union_all(*made).distinct()


@query("s4_scan_list", f"SELECT {_ASSET} FROM v_assets WHERE path IN (SELECT replace(path, '.out', '.txt') FROM v_outputs)")
def s4(spark, sf):
    lines = v.outputs(spark, sf).select(F.concat(F.lit("  "), F.regexp_replace("path", r"\.out$", ".txt"), F.lit(" ")).alias("value"))
    return seconds(scan.listed(lines, v.assets(spark, sf))[0].select("path", "ord", "size", "mtime", "flags"), "mtime")


@query("s4_rejected_lines", "SELECT path FROM v_outputs")
def s4_rejects(spark, sf):
    return scan.listed(v.outputs(spark, sf).select(F.col("path").alias("value")), v.assets(spark, sf))[1]


_OLD = "SELECT path, size, mtime AS last_modified, flags FROM v_manifest_old"


@query("s5_s6_manifest_snapshot", _OLD)
def s5(spark, sf):
    root = f"{store.shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    old = v.manifest_old(spark, sf)
    directories = directories_of(old)
    store.write_manifest(manifest_of(old.limit(0), directories), directories, root)
    store.write_manifest(manifest_of(old, directories), directories, root)
    return full(*store.read_manifest(spark, root))


@query("s7_run_log", "SELECT state, count(*) * 2 AS n FROM v_commands GROUP BY state")
def s7(spark, sf):
    path = f"{store.shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    log = v.commands(spark, sf).select("transition_id", "cmd_ord", "state", "exit_code")
    store.write_run_log(log, path)
    return spark.read.parquet(store.write_run_log(log, f"+{path}")).groupBy("state").agg(F.count("*").alias("n"))


# ---- projections, filters, predicates

PATTERN = r".*/(?<lang>en|fr)/([0-9]+).*"


@query("p1_filter_match", "SELECT * FROM v_paths WHERE regexp_full_match(path, '.*/(en|fr)/([0-9]+).*')")
def p1(spark, sf):
    return pr.filter_match(v.paths(spark, sf), PATTERN)


@query("p2_filter_not_match", "SELECT * FROM v_paths WHERE NOT regexp_full_match(path, '.*/(en|fr)/([0-9]+).*')")
def p2(spark, sf):
    return pr.filter_not_match(v.paths(spark, sf), PATTERN)


@query("p3_positional_captures", "SELECT page_id, path AS c0, regexp_extract(path, '^.*/(en|fr)/([0-9]+).*$', 1) AS c1, regexp_extract(path, '^.*/(en|fr)/([0-9]+).*$', 2) AS c2 FROM v_paths WHERE regexp_full_match(path, '.*/(en|fr)/([0-9]+).*')")
def p3(spark, sf):
    c = pr.positional_captures(F.col("path"), PATTERN)
    return pr.filter_match(v.paths(spark, sf), PATTERN).select("page_id", *[c[str(i)].alias(f"c{i}") for i in range(3)])


@query("p4_named_captures", "SELECT page_id, regexp_extract(path, '^.*/(en|fr)/([0-9]+).*$', 1) AS lang, regexp_extract(path, '^[^/]*\\.(com|net|org)/.*$', 1) AS top FROM v_paths WHERE regexp_full_match(path, '.*/(en|fr)/([0-9]+).*')")
def p4(spark, sf):
    kept = pr.filter_match(v.paths(spark, sf), PATTERN)
    both = pr.overlay(F.create_map(F.lit("lang"), F.lit("initial"), F.lit("top"), F.lit("initial")), pr.overlay(pr.named_captures(F.col("path"), PATTERN), pr.named_captures(F.col("path"), r"[^/]*\.(?<top>com|net|org)/.*")))
    return kept.select("page_id", both["lang"].alias("lang"), both["top"].alias("top"))


@query("p5_recapture", "SELECT ord, 'out/' || source || '-' || lang || '.txt' AS output, source AS src, lang AS c2 FROM v_assets")
def p5(spark, sf):
    t = Template("out/(?<src>{source})-({lang}).txt")
    scope = {"source": F.col("source"), "lang": F.col("lang")}
    c = t.captures(scope)
    return v.assets(spark, sf).select("ord", c["0"].alias("output"), c["src"].alias("src"), c["2"].alias("c2"))


@query("p6_forward_captures", "SELECT path, flags FROM v_assets")
def p6(spark, sf):
    return bl.forward(v.assets(spark, sf)).select("path", "flags")


@query("p7_render_template", "SELECT ord, 'build/' || upper(source) || '/doc_' || ord || '.bak' AS output FROM v_assets")
def p7(spark, sf):
    return v.assets(spark, sf).select("ord", Template("build/{source:upper}/{?:file}.bak").render({"source": F.col("source"), "?": F.col("path")}).alias("output"))


@query("p8_resolve_scoped", "SELECT event_id, coalesce(CASE WHEN value > 50 THEN event_type END, CASE WHEN user_id % 2 = 0 THEN 'even' END, 'default') AS value FROM events")
def p8(spark, sf):
    nested, param = F.when(F.col("value") > 50, F.col("event_type")), F.when(F.col("user_id") % 2 == 0, "even")
    return v.read(spark, sf, "events").select("event_id", jn.resolve_scoped(nested, param, F.lit("default")).alias("value"))


@query("p9_require_resolved", "SELECT ord, source || '.x' AS output FROM v_assets")
def p9(spark, sf):
    return v.assets(spark, sf).select("ord", Template("{source}.x").render({"source": F.col("source")}).alias("output"))


@query("p10_lenient_resolved", "SELECT event_id, coalesce(CASE WHEN value > 50 THEN event_type END, '') || '.x' AS output FROM events")
def p10(spark, sf):
    return v.read(spark, sf, "events").select("event_id", Template("{type}{nothing}.x", strict=False).render({"type": F.when(F.col("value") > 50, F.col("event_type"))}).alias("output"))


@query("p11_assign_unset", "SELECT ord, source || '!' AS mark FROM v_assets")
def p11(spark, sf):
    return unset(assign(v.assets(spark, sf).select("ord", "source", "lang"), "mark", F.concat("source", F.lit("!"))), "source", "lang")


_E = "event_id, CASE WHEN value > 50 THEN event_type END AS a, CASE WHEN user_id % 3 = 0 THEN 'click' WHEN user_id % 3 = 1 THEN '1' ELSE 'FALSE' END AS b"


def _values(spark, sf):
    e = v.read(spark, sf, "events")
    return e.select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("a"), F.when(F.col("user_id") % 3 == 0, "click").when(F.col("user_id") % 3 == 1, "1").otherwise("FALSE").alias("b"))


@query("p12_p15_two_valued", f"SELECT event_id, a IS NOT NULL AS set_a, coalesce(a = b, false) AS eq, NOT coalesce(a = b, false) AS ne, coalesce(regexp_full_match(a, 'c.*'), false) AS lk, NOT coalesce(regexp_full_match(a, 'c.*'), false) AS nlk, lower(b) IN ('1', 'true') AS tr, lower(b) IN ('0', 'false') AS fa FROM (SELECT {_E} FROM events)")
def p12(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _values(spark, sf).select("event_id", pr.is_set(a).alias("set_a"), pr.equals(a, b).alias("eq"), pr.not_equals(a, b).alias("ne"), pr.like(a, "c.*").alias("lk"), pr.not_like(a, "c.*").alias("nlk"), pr.is_true(b).alias("tr"), pr.is_false(b).alias("fa"))


@query("p16_is_file_directory", "SELECT ord, value, value IN (SELECT path FROM v_manifest_old) AS is_file, value IN (SELECT regexp_extract(path, '^(.*)/', 1) FROM v_manifest_old UNION SELECT regexp_extract(path, '^([^/]*)/', 1) FROM v_manifest_old) AS is_directory FROM (SELECT ord, CASE WHEN ord % 2 = 0 THEN path ELSE source || '/' || lang END AS value FROM v_assets)")
def p16(spark, sf):
    df = v.assets(spark, sf).select("ord", F.when(F.col("ord") % 2 == 0, F.col("path")).otherwise(F.concat_ws("/", "source", "lang")).alias("value"))
    old = v.manifest_old(spark, sf)
    return pr.with_is_directory(pr.with_is_file(df, old, "value"), old, "value")


@query("p17_p18_branch", f"SELECT event_id, CASE WHEN coalesce(a = b, false) OR (lower(b) = '1' AND a IS NOT NULL) THEN 'first' WHEN NOT coalesce(a = 'view', false) THEN CASE WHEN a IS NULL THEN 'unset' ELSE 'other' END ELSE 'view' END AS chosen FROM (SELECT {_E} FROM events)")
def p18(spark, sf):
    a, b = F.col("a"), F.col("b")
    inner = pr.branch((~pr.is_set(a), F.lit("unset")), otherwise=F.lit("other"))
    return _values(spark, sf).select("event_id", pr.branch((pr.equals(a, b) | (pr.is_true(b) & pr.is_set(a)), F.lit("first")), (~pr.equals(a, F.lit("view")), inner), otherwise=F.lit("view")).alias("chosen"))


@query("p19_wildcard_match", "SELECT p_partkey, regexp_full_match(p_name, '.*e.*') AS plain, regexp_full_match(lower(p_name), '.*part.*') AS part, regexp_full_match(p_brand, 'Brand.[0-9].*') AS digit FROM part")
def p19(spark, sf):
    p = v.read(spark, sf, "part")
    return p.select("p_partkey", pr.wildcard_match(F.col("p_name"), "*e*").alias("plain"), pr.wildcard_match(F.col("p_name"), "PART", any_case=True, partial=True).alias("part"), pr.wildcard_match(F.col("p_brand"), "Brand?#*").alias("digit"))


# ---- joins


@query("j1_join_dependencies", "SELECT transition_id, count(*) AS edges, min(dep_mtime) AS first FROM v_edges WHERE dependency IS NOT NULL GROUP BY transition_id")
def j1(spark, sf):
    outs = v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("transition_id"))
    deps = v.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transition_id"), F.col("l_shipdate").cast("timestamp").alias("m"))
    return jn.join_dependencies(outs, deps).groupBy("transition_id").agg(F.count("*").alias("edges"), F.unix_seconds(F.min("m")).alias("first"))


@query("j2_enrich_state", "SELECT a.ord, replace(a.path, '.txt', '.out') AS output, CASE WHEN o.path IS NULL THEN 1 ELSE 17 END::BIGINT AS flags, o.mtime FROM v_assets a LEFT JOIN v_outputs o ON o.path = replace(a.path, '.txt', '.out')")
def j2(spark, sf):
    outs = v.assets(spark, sf).select("ord", F.regexp_replace("path", r"\.txt$", ".out").alias("output"), F.lit(1).cast("long").alias("flags"))
    return seconds(jn.enrich_state(outs, v.outputs(spark, sf)), "mtime")


def _deps(spark, sf):
    """Documents' outputs as dependencies of their source's transition; toxic ones are temporary."""
    a = v.assets(spark, sf)
    flags = F.when(F.col("ord") % 5 == 0, 2).when(F.col("ord") % 11 == 0, 10).otherwise(1).cast("long")
    return a.select(F.col("source").alias("transition_id"), F.regexp_replace("path", r"\.txt$", ".out").alias("dependency"), flags.alias("flags"), "ord")


@query("j3_missing_inputs", "SELECT DISTINCT source AS transition_id, replace(path, '.txt', '.out') AS dependency FROM v_assets WHERE ord % 5 <> 0 AND replace(path, '.txt', '.out') NOT IN (SELECT path FROM v_outputs)")
def j3(spark, sf):
    return jn.missing_inputs(_deps(spark, sf), v.outputs(spark, sf))


@query("j4_add_dependencies", "SELECT DISTINCT source AS transition_id, dependency FROM v_assets, (SELECT path AS dependency FROM v_assets WHERE ord IN (1, 2))")
def j4(spark, sf):
    a = v.assets(spark, sf)
    extra = [r[0] for r in a.where("ord IN (1, 2)").select("path").collect()]
    return jn.add_dependencies(a.select(F.col("source").alias("transition_id")).distinct(), extra, a)


@query("j5_m7_manifest_join", _OLD)
def j5(spark, sf):
    old = v.manifest_old(spark, sf)
    d = directories_of(old)
    return full(manifest_of(old, d), d)


@query("j6_prune_directories", "SELECT DISTINCT regexp_extract(path, '^(.*/)', 1) AS dir FROM v_manifest_old WHERE flags = 1")
def j6(spark, sf):
    old = v.manifest_old(spark, sf)
    d = directories_of(old)
    return jn.prune_directories(d, manifest_of(old, d).where("flags = 1")).select("dir")


@query("j7_cascade_delete", "SELECT path, size FROM v_manifest_old WHERE path NOT LIKE '%/en/%'")
def j7(spark, sf):
    old = v.manifest_old(spark, sf)
    d = directories_of(old)
    left = jn.cascade_delete(manifest_of(old, d), d.where(F.col("dir").endswith("/en/")))
    return jn.manifest_join(left, d).select("path", "size")


@query("j8_depends_on_all", "SELECT ord AS transition_id, (SELECT count(*) FROM v_assets WHERE lang = 'en') AS n_dependencies, (SELECT max(mtime) FROM v_assets WHERE lang = 'en') AS newest_dependency FROM v_assets")
def j8(spark, sf):
    a = v.assets(spark, sf)
    return seconds(jn.depends_on_all(a.select(F.col("ord").alias("transition_id")), a.where("lang = 'en'")).drop("digest"), "newest_dependency")


@query("j9_remains", "SELECT path, size FROM v_manifest_old WHERE path NOT IN (SELECT path FROM v_manifest_new)")
def j9(spark, sf):
    return jn.remains(v.manifest_old(spark, sf), v.manifest_new(spark, sf)).select("path", "size")


@query("j10_asset_exists", "SELECT ord, CASE WHEN path IN (SELECT path FROM v_manifest_old) THEN 'true' ELSE 'false' END AS exists FROM v_assets")
def j10(spark, sf):
    return jn.with_exists(v.assets(spark, sf).select("ord", "path"), v.manifest_old(spark, sf), "path").select("ord", "exists")


@query("j11_asset_rexists", "SELECT source, CASE WHEN EXISTS (SELECT 1 FROM v_manifest_old m WHERE regexp_full_match(m.path, s.source || '/fr/doc_[0-9]*1\\.txt')) THEN 'true' ELSE 'false' END AS rexists FROM (SELECT DISTINCT source FROM v_assets) s")
def j11(spark, sf):
    patterns = v.assets(spark, sf).select("source").distinct().withColumn("pattern", F.concat("source", F.lit(r"/fr/doc_[0-9]*1\.txt")))
    return jn.with_pattern_exists(patterns, v.manifest_old(spark, sf)).drop("pattern")


@query("j11_rexists_alternatives", """
WITH p AS (SELECT DISTINCT source, lang FROM v_assets),
q AS (SELECT source || '/' || lang || '/gone|' || source || '/' || lang || '/doc_[0-9]+\\.txt' AS pattern FROM p UNION ALL SELECT source || '/?' || lang || '/+doc_[0-9]*7\\.txt' FROM p UNION ALL SELECT source || '/' || lang || '/(doc|x|y/z)_[0-9]{2}\\.txt' FROM p)
SELECT pattern, CASE WHEN EXISTS (SELECT 1 FROM v_manifest_old m WHERE regexp_full_match(m.path, q.pattern)) THEN 'true' ELSE 'false' END AS rexists FROM q""")
def j11_alternatives(spark, sf):
    # Alternatives and repeated slashes undo what looks like a literal directory.
    kinds = ["%1$s/%2$s/gone|%1$s/%2$s/doc_[0-9]+\\.txt", "%1$s/?%2$s/+doc_[0-9]*7\\.txt", "%1$s/%2$s/(doc|x|y/z)_[0-9]{2}\\.txt"]
    pairs = v.assets(spark, sf).select("source", "lang").distinct()
    patterns = pairs.select(F.explode(F.array(*[F.format_string(k, "source", "lang") for k in kinds])).alias("pattern"))
    return jn.with_pattern_exists(patterns, v.manifest_old(spark, sf))


@query("j11_rexists_absolute", """
WITH f AS (SELECT '/' || regexp_replace(path, '//+', '/', 'g') AS path FROM v_paths UNION SELECT '/data/' || path FROM v_assets),
q AS (SELECT DISTINCT '/' || split_part(path, '/', 1) || '/[a-z]+/[0-9]+.*' AS pattern FROM v_paths UNION SELECT DISTINCT '/data/' || source || '/(en|fr)/doc_[0-9]*9\\.txt' FROM v_assets UNION SELECT DISTINCT '/data/' || source || '/x?.*' FROM v_assets)
SELECT pattern, CASE WHEN EXISTS (SELECT 1 FROM f WHERE regexp_full_match(f.path, q.pattern)) THEN 'true' ELSE 'false' END AS rexists FROM q""")
def j11_absolute(spark, sf):
    # Absolute paths, as scans give them: of pages and of documents.
    pages, docs = v.paths(spark, sf).select("path"), v.assets(spark, sf)
    files = pages.select(F.concat(F.lit("/"), F.regexp_replace("path", "//+", "/")).alias("path")).unionByName(docs.select(F.concat(F.lit("/data/"), "path").alias("path")))
    host = pages.select(F.concat(F.lit("/"), F.split("path", "/")[0], F.lit("/[a-z]+/[0-9]+.*")).alias("pattern"))
    kinds = ["/data/%s/(en|fr)/doc_[0-9]*9\\.txt", "/data/%s/x?.*"]
    patterns = host.unionByName(docs.select(F.explode(F.array(*[F.format_string(k, "source") for k in kinds])).alias("pattern"))).distinct()
    return jn.with_pattern_exists(patterns, files)


# ---- aggregates


@query("a1_a4_combine_all", "SELECT source, lang, string_agg(path, ' ' ORDER BY ord) AS inputs, string_agg('\"' || path || '\"', ' ' ORDER BY ord) AS quoted, min_by(path, ord) AS first, max(mtime) AS newest FROM v_assets GROUP BY source, lang")
def a1(spark, sf):
    p, o = F.col("path"), F.col("ord")
    out = v.assets(spark, sf).groupBy("source", "lang").agg(ag.combine_all(p, o).alias("inputs"), ag.combine_all_quoted(p, o).alias("quoted"), ag.first_input(p, o).alias("first"), ag.most_recent_change(F.col("mtime")).alias("newest"))
    return seconds(out, "newest")


@query("a1_combined_parts", "SELECT source, part, count(*) AS n, string_agg(path, ' ' ORDER BY ord) AS inputs FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY ord, path) - 1) // 1000 AS part FROM v_assets) GROUP BY source, part")
def a1_parts(spark, sf):
    return ag.combined_parts(v.assets(spark, sf), ["source"], 1000)


@query("a5_oldest_output", "SELECT split_part(path, '/', 1) AS source, min(mtime) FILTER ((flags & 2) = 0) AS oldest FROM v_outputs GROUP BY 1")
def a5(spark, sf):
    out = v.outputs(spark, sf).groupBy(F.split("path", "/")[0].alias("source")).agg(ag.oldest_output_change(F.col("mtime"), F.col("flags")).alias("oldest"))
    return seconds(out, "oldest")


@query("a6_state_rollup", "SELECT source, bool_and(o.path IS NOT NULL) AS all_output_exists, bool_and(a.ord % 3 <> 0) AS all_input_exists, bool_or(a.ord % 7 = 0) AS input_was_modified, bool_or(coalesce(o.mtime < a.mtime, false)) AS output_will_be_modified FROM v_assets a LEFT JOIN v_outputs o ON o.ord = a.ord GROUP BY source")
def a6(spark, sf):
    o = v.outputs(spark, sf).select("ord", F.col("mtime").alias("om"))
    j = v.assets(spark, sf).join(o, "ord", "left")
    return j.groupBy("source").agg(*ag.state_rollup(F.col("ord") % 3 != 0, F.col("om").isNotNull(), F.col("ord") % 7 == 0, F.coalesce(F.col("om") < F.col("mtime"), F.lit(False))))


@query("a7_needs_build_any", "SELECT source, bool_or(ord % 97 = 0 AND ord % 2 = 0) AS any_build FROM v_assets GROUP BY source")
def a7(spark, sf):
    a = v.assets(spark, sf).withColumn("flags", F.when(F.col("ord") % 97 == 0, 4).otherwise(16).cast("long")).withColumn("mtime", F.when(F.col("ord") % 2 == 0, F.col("mtime")))
    return a.groupBy("source").agg(ag.needs_build_any(F.col("flags"), F.col("mtime")).alias("any_build"))


def _edge_flags(spark, sf):
    e = v.edges(spark, sf)
    late = F.coalesce(F.max(F.col("dep_mtime") > F.col("out_mtime") + F.expr("INTERVAL 100 DAYS")).over(Window.partitionBy("output")), F.lit(False))
    return e.withColumn("flags", F.lit(16) + F.when(late, 4).otherwise(0))


@query("a8_dependent_map", "SELECT output, CASE WHEN bool_or(dep_mtime > out_mtime + 100 * 86400) THEN list_sort(list_distinct(list(dependency))) ELSE [] END AS dependencies FROM v_edges GROUP BY output")
def a8(spark, sf):
    return ag.flat_dependent_map(_edge_flags(spark, sf).select("output", "flags", "dependency"))


@query("a9_duplicates", "SELECT 'hosts' AS process, 'input' AS role, split_part(path, '/', 1) AS path, count(*) AS n FROM v_paths GROUP BY 3 HAVING count(*) > 1")
def a9(spark, sf):
    return ag.find_duplicates(v.paths(spark, sf).select(F.lit("hosts").alias("process"), F.lit("input").alias("role"), F.split("path", "/")[0].alias("path")))


@query("a10_count_commands", "SELECT count(*) AS n_commands FROM lineitem")
def a10(spark, sf):
    return ag.count_commands(v.commands(spark, sf).groupBy("transition_id").agg(F.count("*").alias("commands")))


@query("a11_run_summary", "SELECT process, CASE WHEN count(*) FILTER (state = 'FAILED') > 0 THEN 'FAILED' WHEN bool_and(state = 'FINISHED') THEN 'FINISHED' ELSE 'RUNNING' END AS state, count(*) AS n_commands, count(*) FILTER (state = 'FAILED') AS n_failed, count(*) FILTER (NOT output_exists) AS n_missing_outputs, sum(seconds)::BIGINT AS seconds FROM v_commands GROUP BY process")
def a11(spark, sf):
    return ag.run_summary(v.commands(spark, sf))


# ---- windows

_SPEED = """
WITH w AS (SELECT *, sum(value) OVER o AS current, first(ts) OVER o AS start, count(*) OVER r AS n, sum(value) OVER r - first(value) OVER r AS more, first(ts) OVER r AS since FROM v_progress
  WINDOW o AS (PARTITION BY series ORDER BY ts, event_id), r AS (PARTITION BY series ORDER BY ts, event_id ROWS 2 PRECEDING)),
x AS (SELECT *, CASE WHEN n > 1 THEN more ELSE value END AS moved, (epoch_us(ts) // 1000 - epoch_us(CASE WHEN n > 1 THEN since ELSE start END) // 1000) AS ms, epoch_us(ts) // 1000 - epoch_us(start) // 1000 AS all_ms FROM w),
s AS (SELECT *, CASE WHEN total = 0 OR current = 0 THEN NULL WHEN current = total THEN 0.0 WHEN ms <= 0 OR moved <= 0 THEN 'inf'::DOUBLE ELSE moved / (ms / 1000.0) END AS recent,
  CASE WHEN total = 0 OR current = 0 THEN NULL WHEN current = total THEN 0.0 WHEN all_ms <= 0 THEN 'inf'::DOUBLE ELSE current / (all_ms / 1000.0) END AS overall FROM x)
"""


_PROGRESS = _SPEED + "SELECT event_id, round(recent, 9) AS recent_speed, round(overall, 9) AS global_speed, CASE WHEN current = total THEN 0.0 WHEN recent = 'inf'::DOUBLE THEN recent ELSE floor(1000.0 * (total - current) / recent + 0.5) END AS eta_ms, round(CASE WHEN total <= 0 THEN 100.0 ELSE 100.0 * current / total END, 6) AS percent FROM s"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.round("recent_speed", 9).alias("recent_speed"), F.round("global_speed", 9).alias("global_speed"), "eta_ms", F.round("percent", 6).alias("percent"))


@query("w1_w4_progress", _PROGRESS)
def w1(spark, sf):
    return _rounded(wn.with_progress(v.progress(spark, sf)))


@query("w1_w4_progress_by_ranges", _PROGRESS)
def w1_ranges(spark, sf):
    return _rounded(wn.with_progress_by_ranges(v.progress(spark, sf)))


@query("w5_keep_latest", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def w5(spark, sf):
    return wn.keep_latest(v.read(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


_EXECUTED = "SELECT transition_id, count(*) FILTER (executed) AS executed, count(*) FILTER (NOT executed) AS skipped FROM (SELECT transition_id, NOT coalesce(bool_or(exit_code <> 0) OVER (PARTITION BY transition_id ORDER BY cmd_ord, part, supp, price, exit_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS executed FROM v_commands) GROUP BY transition_id"


def _executed(df: DataFrame) -> DataFrame:
    return df.groupBy("transition_id").agg(F.count_if("executed").alias("executed"), F.count_if(~F.col("executed")).alias("skipped"))


@query("w6_stop_at_first_failure", _EXECUTED)
def w6(spark, sf):
    return _executed(wn.stop_at_first_failure(v.commands(spark, sf), ["cmd_ord", "part", "supp", "price", "exit_code"]))


@query("w6_first_failure_by_minimum", _EXECUTED)
def w6_minimum(spark, sf):
    return _executed(wn.stop_at_first_failure_by_minimum(v.commands(spark, sf), ["cmd_ord", "part", "supp", "price", "exit_code"]))


@query("w7_first_reason", "WITH b AS (SELECT transition_id, dep_ord * 4 + CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS ord, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 4 ELSE 0 END AS bits FROM v_edges WHERE dependency IS NOT NULL) SELECT transition_id, coalesce(min_by(bits, ord) FILTER (bits <> 0), 0)::BIGINT AS reason, bit_or(bits)::BIGINT AS all_reasons FROM b GROUP BY transition_id")
def w7(spark, sf):
    e = v.edges(spark, sf).where("dependency IS NOT NULL")
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    bits = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 4).otherwise(0)
    out = wn.first_reason(e.select("transition_id", F.lit("dependency").alias("role"), (F.col("dep_ord") * 4 + kind).alias("ord"), bits.alias("bits")))
    return out.select("transition_id", F.col("reason").cast("long").alias("reason"), F.col("all_reasons").cast("long").alias("all_reasons"))


# ---- order and sets


@query("t1_ordered_distinct", "SELECT DISTINCT split_part(path, '/', 1) AS path FROM v_paths")
def t1(spark, sf):
    return st.ordered_distinct(v.paths(spark, sf).select(F.split("path", "/")[0].alias("path")))


@query("t2_lookup", "SELECT regexp_extract(path, '^(.*/)', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS file, size FROM v_manifest_old WHERE path IN (SELECT path FROM v_manifest_new)")
def t2(spark, sf):
    keys = files_of(v.manifest_new(spark, sf)).select("dir", "file")
    return st.lookup_many(files_of(v.manifest_old(spark, sf)).select("dir", "file", "size"), keys)


@query("t3_ordered_replace", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(path, '[0-9]+', 'N', 'g'), 'N', '#', 'g'), '(en|fr)/', '<\\1>', 'g') AS path FROM v_paths")
def t3(spark, sf):
    rules = {2: ("(en|fr)/", r"<\1>"), None: ("[0-9]+", "N"), 1: ("N", "#")}
    return v.paths(spark, sf).select("page_id", st.ordered_replace(F.col("path"), rules).alias("path"))


@query("u1_union_all", "SELECT path FROM v_manifest_old UNION ALL SELECT path FROM v_manifest_new")
def u1(spark, sf):
    return st.union_all(v.manifest_old(spark, sf).select("path"), v.manifest_new(spark, sf).select("path"))


@query("u2_add_input", "SELECT 'plus' AS mode, path FROM (SELECT path FROM v_manifest_old UNION ALL SELECT path FROM v_manifest_new) UNION ALL SELECT 'own', path FROM v_manifest_old UNION ALL SELECT 'upstream', path FROM v_manifest_new")
def u2(spark, sf):
    own, up = v.manifest_old(spark, sf).select("path"), v.manifest_new(spark, sf).select("path")
    cases = {"plus": st.add_input(own, up, True), "own": st.add_input(own, up, False), "upstream": st.add_input(None, up, False)}
    return st.union_all(*[df.select(F.lit(k).alias("mode"), "path") for k, df in cases.items()])


@query("u3_distinct_missing", "SELECT DISTINCT source AS process, lang AS dependency FROM v_assets")
def u3(spark, sf):
    return st.distinct_missing(v.assets(spark, sf).select(F.col("source").alias("process"), F.col("lang").alias("dependency")))
